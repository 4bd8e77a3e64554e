"""Tokens, chat, fingerprints, classifier and page text: round trips, plain versions, held-out accuracy."""

import base64
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import sha, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issue_signals.llm import boosting, bpe, chat, html_extract, html_tree, quality
from issue_signals.llm import weighted_fingerprints as cws
from issue_signals.llm.html_pages import Maker
from issue_signals.llm.queries import VOCABULARY, ids_digest, op7_chat_formatting, token_digests

EXTRA = ("ids", "term", "weight", "range", "role2", "words", "score", "version", "kept", "model", "at", "row", "__score", "__kept")


def with_extra(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [
    "", " ", "\n", "a b\n", "x  y", " a", "a\n\nb", "a\tb", "a b c", "q \x1c r", "a\x85b", "a\x1fb", "it's I'll 'd", "a b c", "a​ b",
    "<|endoftext|><|im_start|>", "a" * 5000, "ab" * 3000, " " * 3000, "日本語 한국어 привет 𝄞", "1234567 12 1", "hehehehe thethethe", "a \nb", "a\n b",
]


def encoded_by_us(texts):
    return [np.frombuffer(x, "<i4").tolist() for x in bpe.encode_texts(texts, VOCABULARY, public_tokenizers.PATTERN)]


def test_ids_equal_the_library(library):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz   \n\t'éèñßABC0123.,!?-日한п𝄞"
    texts = ODD + ["".join(r.choices(letters, k=r.randint(0, 300))) for _ in range(400)] + ["".join(r.choices("theandigr", k=300)) for _ in range(300)]
    assert encoded_by_us(texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_any_text_equals_the_library_and_comes_back(text):
    ranks = bpe.ranks(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    (ids,) = encoded_by_us([text])
    assert ids == library.encode_ordinary(text) and bpe.decode_ids(ids, VOCABULARY).decode() == text


def test_small_memory_gives_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KNOWN", 50)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 100)
    r = random.Random(2)
    texts = ODD + [" ".join("".join(r.choices("abcdef.,", k=r.randint(1, 6))) for _ in range(60)) for _ in range(40)]
    for k in range(0, len(texts), 7):
        assert encoded_by_us(texts[k : k + 7]) == [library.encode_ordinary(t) for t in texts[k : k + 7]]


def test_token_digests(spark, library):
    rows = [*enumerate(ODD), (900, None), (None, "a b"), (901, "same"), (901, "same")]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(tuple(r) for r in token_digests(docs, VOCABULARY).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).collect())
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want)
    assert token_digests(docs.limit(0), VOCABULARY).count() == 0
    assert spark.range(1).select(ids_digest(F.array(F.lit(3), F.lit(14)))).first()[0] == sha("3,14")


@given(st.text(alphabet="<|\\>im_startend\n a", max_size=60))
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.unescape_role(chat.escape_role(text)) == text
    assert chat.START not in chat.escape(text) and chat.END not in chat.escape(text) and "\n" not in chat.escape_role(text)


def test_turns_come_back_and_the_mask_covers_what_the_assistant_says(spark):
    tricky = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 1, "assistant", tricky), (1, 0, "user", tricky + "<\\|"), (2, 0, None, None), (2, 1, "assistant", ""), (2, None, "sys\ntem\\n", "x\n"),
        (None, 0, "assistant", "é 𝄞"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b"), (3, 9, "assistant", "c"), (4, 0, "<|im_end|>", "d"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "loss_mask": F.lit(2)})
    got = {r.conv_id: r for r in chat.conversation_digests(chat.formatted(frame, VOCABULARY), VOCABULARY).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        learnt = "".join(t or "" for _, _, role, t in own if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)))
        assert (g.loss_chars, g.loss_sha256) == (len(learnt), sha(learnt))
        plain = sum(len(chat.START + chat.escape_role(r or "") + "\n" + chat.escape(t or "") + chat.END + "\n") for _, _, r, t in own)
        assert g.formatted_chars == plain
    assert chat.conversation_digests(chat.formatted(frame.limit(0), VOCABULARY), VOCABULARY).count() == 0
    start = bpe.vocabulary_size(VOCABULARY)
    ((ids, mask),) = chat.turns_ids(["assistant"], [tricky], VOCABULARY, ("assistant",))
    assert [i for i in ids.tolist() if i >= start] == [start, start + 1] and bpe.decode_ids(ids[mask == 1].tolist(), VOCABULARY).decode() == chat.escape(tricky)


def test_whole_conversations(spark):
    assert op7_chat_formatting(spark, "/root/testdata/sf0.001").filter("conv_id = -1 AND n_turns = 2 AND loss_chars = 34").count() == 1


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """400 samples: the standard error is at most 0.025."""
    r = random.Random(4)
    a = " ".join(r.choices(["x", "y"], k=600))
    rows = [(0, a), (1, a[:600]), (2, a[300:] + " " + a[:300]), (3, " ".join(r.choices(["x", "y", "z"], k=600))), (4, a)]
    made = cws.signatures(spark.createDataFrame(rows, "doc_id long, text string"), "text", samples=100)
    got = {x.doc_id: x.signature for x in made.collect()}
    got = {k: np.array(v) for k, v in got.items()}
    assert (got[0] == got[4]).all()
    for i in range(4):
        for j in range(i):
            true = jaccard(shingles(rows[i][1]), shingles(rows[j][1]))
            assert (got[i] == got[j]).mean() == pytest.approx(true, abs=4 * max(0.02, (true * (1 - true) / 100) ** 0.5))


def test_a_pair_of_texts_has_the_signatures_of_each(spark):
    """What two texts share is drawn once, and a term has other weights in the two."""
    r = random.Random(6)
    texts = ["", "a b", "a b c d e", *(" ".join(r.choices(letters, k=n)) for letters in ("ab", "abcdefghijkl") for n in (9, 40, 200))]
    rows = [(i * len(texts) + j, a, b) for i, a in enumerate(texts) for j, b in enumerate([*texts[:4], a, a[: len(a) // 2] + texts[-1][:30]])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edited string").dropDuplicates(["doc_id"])
    pairs = {x.doc_id: (x.signature, x.other_signature) for x in cws.paired_signatures(frame, "text", "edited", 8).collect()}
    for k, name in enumerate(("text", "edited")):
        alone = {x.doc_id: x.signature for x in cws.signatures(frame.select("doc_id", name), name, 8).collect()}
        assert {i: p[k] for i, p in pairs.items()} == alone and len(alone) == len(rows)


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(cws, "ROWS_PER_RANGE", 4)
    r = random.Random(5)
    texts = [None, "", " ", "a", "a b c d", "a b c d e", "é𝄞 ü" * 9, " lead and trail \n", *(" ".join(r.choices("abcdefgh", k=r.randint(3, 90))) for _ in range(22))]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(9, texts[20]), (9, texts[20]), (None, "no id a b c d e f"), (None, "no id either")]
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string"))
    got = cws.edited_fingerprints(docs, samples=8)
    assert got.count() == len(rows)
    hashes = {t: h for t, h in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]]))
    found, prints = Counter(), {}
    for g in got.collect():
        found[g.doc_id, g.n_chars, g.edited_sha256] += 1
    want = Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, half = t or "", len(t or "") // 2
        want[i, len(t), sha(t[: len(t) - half] + (following or "")[:half])] += 1
    assert found == want
    by_text = {}
    ids = {i: t or "" for i, t in rows if i is not None and i != 9}
    for g in got.filter("doc_id <> 9").collect():
        assert by_text.setdefault(ids[g.doc_id], g.fingerprint) == g.fingerprint and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    assert len(set(by_text.values())) >= len({tuple(words(t)) for t in by_text}) and by_text[""] == by_text[" "] == "0" * 64
    assert cws.edited_fingerprints(docs.limit(0)).count() == 0
    (only,) = cws.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert only.near_next == 1.0 and only.edited_sha256 == sha("a b c a b c")
    assert cws.fingerprints(docs, samples=8).filter("doc_id = 3").first().fingerprint == "0" * 64


def test_quality_on_rows_the_fit_has_not_seen(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    rows = rows.select("doc_id", "text", "quality", "toxic").toPandas().sort_values("doc_id")
    held = rows.text.map(lambda t: int(sha(t)[:4], 16) % 4 == 0)  # by text, so that copies don't tell
    train = rows[~held]
    model = quality.fit([quality.features(t) for t in train.text], (train.quality + 1 - train.toxic).to_numpy())
    test = rows[held]
    best = 1 / (1 + np.exp(model.thresholds[-1] - np.array([model.score(quality.features(t)) for t in test.text])))
    kept = best >= quality.KEEP_FROM
    clean = ((test.quality == 1) & (test.toxic == 0)).to_numpy()
    assert kept[clean].mean() > 0.98 and kept[(test.toxic == 1).to_numpy()].mean() < 0.1 and kept[(test.quality == 0).to_numpy()].mean() < 0.1
    assert (np.diff(model.thresholds) > 0).all()


def test_ordinal_gradient_finds_the_likeliest_thresholds():
    grades = np.array([0] * 20 + [1] * 30 + [2] * 50)
    model = quality.fit([np.array([1, 2])] * 100, grades, steps=600)
    assert 1 / (1 + np.exp(model.thresholds)) == pytest.approx([0.8, 0.5], abs=0.02)
    assert quality.fit([], np.zeros(0, int)).score(np.array([1])) == 0 and quality.fit([np.array([1])], np.array([1])).score(np.array([1])) == 0


def test_graded_documents_equal_the_model_row_by_row(spark):
    texts = [None, "", "good words here", "BAD!! BAD!!", "x " * 3000] + [f"text {i} {'awful' if i % 3 == 0 else 'fine'}" for i in range(60)]
    docs = with_extra(spark.createDataFrame(list(enumerate(texts)) + [(None, "awful"), (4, "awful")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 0 if i % 3 == 2 else 2) for i in range(5, 65)] + [(None, 1), (5, None), (6, 2)], "doc_id long, grade int")
    model = quality.trained(docs, labels)
    again = quality.trained(docs.repartition(5), labels.repartition(3))
    assert (model.hashes == again.hashes).all() and np.allclose(model.weights, again.weights)
    rows = quality.graded(docs, model).collect()
    assert len(rows) == 67
    for r in rows:
        if r.doc_id is not None and r.doc_id != 4:
            score = model.score(quality.features(texts[r.doc_id]))
            tails = 1 / (1 + np.exp(model.thresholds - score))
            assert r.score == pytest.approx(score) and r.tails == pytest.approx(tails) and r.expected_grade == pytest.approx(tails.sum())
            assert r.kept == (tails[-1] >= quality.KEEP_FROM)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)
    nothing = quality.trained(docs, labels.limit(0))
    assert quality.graded(docs, nothing).filter("kept").count() == 67 and quality.graded(docs.limit(0), model).count() == 0


def test_trees_separate_what_one_split_cannot():
    r = np.random.default_rng(1)
    rows = r.normal(size=(3000, 3))
    labels = ((rows[:, 0] > 0) ^ (rows[:, 1] > 0)).astype(float)
    model = boosting.fit_trees(rows[:2000], labels[:2000], trees=20, depth=3)
    assert ((model.log_odds(rows[2000:]) > 0) == (labels[2000:] > 0)).mean() > 0.95
    constant = boosting.fit_trees(np.zeros((10, 2)), np.ones(10), trees=2)
    assert (constant.log_odds(np.zeros((3, 2))) > 0).all() and len(constant.log_odds(np.zeros((0, 2)))) == 0


@pytest.fixture(scope="module")
def extractor(spark):
    return html_extract.trained(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_given_pages_give_their_articles(spark, extractor):
    """The given pages mark their articles; the extractor is not told."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html_extract.extracted(pages, extractor).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*?)(</article>|$)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert r.text == re.sub(r"\s+", " ", unescape(inner)).strip()


def test_unseen_layouts(extractor):
    maker = Maker(open(__file__).read().split(), 77)
    right = total = exact = 0
    for _ in range(150):
        page, label = html_extract.labelled(maker.page())
        chosen = html_tree.decode(page, extractor.trees.log_odds(html_tree.features(page, extractor.tag_scores, extractor.token_scores)))
        at = [v for v in range(len(label)) if page.texts[v]]
        right += sum(chosen[v] == label[v] for v in at)
        total += len(at)
        exact += all(chosen[v] == label[v] for v in at)
        assert all(not chosen[v] or chosen[page.parents[v]] for v in range(1, len(label)))
    assert right / total > 0.97 and exact / 150 > 0.75


def test_a_plain_page(extractor):
    said = "The first paragraph of the article says quite a lot of things about the matter at hand, and it goes on. "
    html = f"""<html><head><title>No &amp; no</title><script>var x = "<p>no</p>";</script></head><body>
      <nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>
      <article><h1>A &lt;title&gt;</h1><p>{said * 3}<p>Second&nbsp;one\n\twith <b>bo</b>ld.<br>Line</article>
      <div class="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with that at all, it is quite wrong.</p></div></div>
      <footer>&copy; 2024 Example</footer></body></html>"""
    assert extractor.texts([html])[0] == "A <title> " + (said * 3).strip() + " Second one with bold. Line"


def test_elements_inside_an_article(extractor):
    """Only scripts, styles, templates and titles are unseen; an element that never ends swallows nothing."""
    said = "The first paragraph of the article says quite a lot of things about the matter at hand, and it goes on. "
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Heading of it</h1><p>{}</p><p>{}</p></article><footer>&copy; 2024 Example</footer></body></html>"
    start = "Heading of it "
    for inner, shown in [
        ("Let <math><mi>x</mi><mo>=</mo><mn>5</mn></math> hold.", "Let x=5 hold."),
        ("See <svg width=9><title>icon</title><text>label</text></svg> here.", "See label here."),
        ("See <svg><path d='M0'/> here.", "See here."),
        ("See <svg/> here.", "See here."),
        ("A <iframe src=x> line.", "A line."),
        ("An <object data=x> line.", "An line."),
        ("A <noscript> line.", "A line."),
        ("A <select><option> line.", "A line."),
        ("A <textarea/> line.", "A line."),
        ("A <style>p { x: y }</style> line <script>var x = 1;</script>of <template><p>no</p></template>it.", "A line of it."),
    ]:
        got = extractor.texts([page.format(inner + " " + said * 2, said * 2)])[0]
        assert got == start + shown + " " + (said * 2).strip() + " " + (said * 2).strip(), inner
    choice = "<form><label>Pick</label><select><option>One</option><option>Two</option></select><textarea>Say it</textarea><button>Go</button></form>"
    got = extractor.texts([page.format(said * 2, said * 2 + "</p>" + choice + "<noscript>Please turn on scripts</noscript><p>" + said)])[0]
    assert got == start + " ".join([(said * 2).strip(), (said * 2).strip(), said.strip()])


def test_page_edges(spark, extractor):
    broken = ["", None, "<", "<p", "plain text", "</div></p>", "<![foo[x]]><p>", "<script>never closed", "<div>" * 3000, "<title>a<body>", "&#xZZ; &amp", "<ul><li>a<li>b</ul>"]
    pages = with_extra(spark.createDataFrame([(i, None, h) for i, h in enumerate(broken)] + [(0, "u", "")], "page_id long, url string, html string"))
    rows = html_extract.extracted(pages, extractor).collect()
    assert len(rows) == len(broken) + 1 and all(isinstance(r.text, str) for r in rows)
    assert {r.text for r in rows if r.page_id in (0, 1, 7)} == {""}
    assert html_extract.extracted(pages.limit(0), extractor).count() == 0
    assert html_extract.trained(pages.filter("page_id = 1")).texts([""]) == [""]


def test_likeness_at_the_production_count_is_near_the_exact_similarity(spark):
    """near_edited and near_next against generalised Jaccard: a mean square error of J (1 - J) / 32, not / 16."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text or "" for r in docs.collect()}

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])

    def jaccard(a, b):
        x, y = shingles(a), shingles(b)
        return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0

    ids = sorted(text, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    squares = expected = 0.0
    for r in cws.edited_fingerprints(docs).collect():
        own, following = text[r.doc_id], text[after[r.doc_id]]
        half = len(own) // 2
        for got, other in ((r.near_edited, own[: len(own) - half] + following[:half]), (r.near_next, following)):
            want = jaccard(own, other)
            squares += (got - want) ** 2
            expected += want * (1 - want)
    assert squares < 1.4 * expected / 32
