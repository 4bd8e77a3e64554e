"""Values that results depend on and that therefore must stay as they are."""

# --- fixed values: polarity lexicons -------------------------------------------------
POSITIVE_WORDS = [
    "good", "great", "excellent", "benefit", "like", "love", "improve", "better", "fix", "solve",
    "easy", "useful", "solved", "success", "fast",
]
NEGATIVE_WORDS = [
    "bad", "poor", "issue", "bug", "problem", "difficult", "fail", "crash", "error", "slow",
    "breaks", "broken", "missing", "cannot", "wrong",
]

# --- fixed values: content types, in order of precedence -----------------------------
CONTENT_TYPE_WORDS = {
    "bug_fix": ["fix", "issue", "bug", "crash", "error", "problem", "vulnerability"],
    "feature": ["add", "feature", "implement", "new", "enhancement", "request"],
    "dependency": ["bump", "update", "upgrade", "dependency", "version"],
    "documentation": ["doc", "documentation", "example", "guide", "manual"],
}
CONTEXT_WORDS = {
    "bug_fix": ["fix", "issue", "bug", "problem"],
    "feature": ["add", "feature", "implement", "new"],
    "dependency": ["bump", "update", "upgrade", "dependency"],
    "documentation": ["doc", "guide", "example"],
}

# --- fixed values: wording of reasons, (positive, negative) --------------------------
REASON_PHRASES = {
    "bug_fix": ("Fixed issue improving", "Problem affecting"),
    "feature": ("Feature enhancing", "Feature request for"),
    "dependency": ("Dependency update improving", "Dependency issue affecting"),
    "documentation": ("Documentation clarifying", "Documentation needed for"),
    "general": ("Content highlights good", "Content indicates issues with"),
}
INVALID_CONTEXT = "Content not available or contains invalid characters"
INVALID_SENTIMENT_TEXT = "Invalid content"

# --- fixed values: limits and cut-offs -----------------------------------------------
MENTION_THRESHOLD = 0.05
MATCH_THRESHOLD = 0.3
MIN_PROJECT_ISSUES = 100
TITLE_CHARS = 150
WORD_PROMPT = "Software quality attribute: "

# --- fixed values: hypothesis templates, one list per version ------------------------
HYPOTHESIS_TEMPLATES = {
    "v0": [
        "The text is related to the quality attribute '{attribute}'.",
        "The text is about {attribute} as defined by: {definition}.",
        "The text is about one or some of these related words: {related_words}.",
        "The text mentions {attribute} or is relevant to {attribute}.",
        "The text concerns aspects like: {related_words}.",
    ],
    "v1": [
        "This text is related to the quality attribute '{attribute}'.",
        "This text discusses '{attribute}' or is relevant to {attribute}.",
        "This text focuses on '{first_word}', a key aspect of '{attribute}'.",
    ],
    "v2": [
        "This text is related to the quality attribute '{attribute}'.",
        "This text is about '{attribute}' as defined by: {definition}.",
        "The content aligns with the definition of {attribute}: {definition}.",
    ],
    "v3": [
        "This text is related to the quality attribute '{attribute}'.",
        "This text is about one or some of these related words: {related_words}.",
        "The content discusses aspects like {related_words}.",
    ],
    "v4": [
        "Is this text about {attribute}?",
        "Is this text related to topics like {related_words}?",
        "Does this concern {attribute} according to the definition: {definition}?",
    ],
    "v5": [
        "Determine whether the text concerns {attribute}.",
        "Check if this text is related to the quality attribute '{attribute}'.",
        "Check if this text speaks about a concern that is defined like '{definition}'.",
    ],
    "v6": [
        "This text raises concerns typically associated with '{attribute}', which includes topics like {related_words}.",
        "This text appears to be discussing '{attribute}', possibly referencing: {related_words}.",
    ],
}
LABELLING_TEMPLATES = [
    "The text is related to the quality attribute '{attribute}'.",
    "The text is about {attribute} as defined by: {definition}.",
    "The text is about one of these related words: {related_words}.",
    "The text mentions {attribute} or is relevant to {attribute}.",
    "The text concerns aspects like: {related_words}.",
]
VOTE_INSTRUCTION = (
    "You are a scholarly researcher. You will receive an issue text and a list of quality "
    "attribute-related hypotheses. Respond with 'yes' if the text matches any of the hypotheses. "
    "Otherwise, respond with 'no'.\nHypotheses:\n - "
)
VOTE_QUESTION = "\nIs this text relevant?"

# --- fixed values: evaluation settings -----------------------------------------------
CHUNKINGS = ["sentence", "paragraph", "newline"]
THRESHOLD_LISTS = [[0.60, 0.55, 0.50, 0.45, 0.40], [0.70, 0.65, 0.60, 0.55], [0.80, 0.70, 0.60]]
TOKEN_LIMITS = [128, 256, 512]
SCORE_AGGREGATIONS = ["max", "mean"]
VOTE_AGGREGATIONS = ["majority_vote", "unanimous", "first_yes", "trial_ratio_threshold"]
VOTE_RATIO = 0.6
LABELLING_THRESHOLDS = [0.90, 0.85, 0.80, 0.75, 0.70]
