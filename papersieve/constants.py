"""Fixed values.

Everything in this module is a FIXED VALUE: a literal that must stay equal to
what the screening method defines (answer vocabulary, tree feature order, the
TTL, the threshold grid, the hyper-parameter grids) or to the hand fixtures in
FIXTURES.md (rule patterns, the fixture node table).  Nothing here is computed.
"""

from __future__ import annotations

# --- FIXED VALUES: answer vocabulary -----------------------------------------
ANSWERS = ("YES", "NO", "UNSURE")

# --- FIXED VALUES: the eight tree features, in model column order ------------
FEATURE_ORDER = ["I01", "I10", "I13", "I16", "I17", "I04", "I05", "I07"]

# --- FIXED VALUES: answer memo ---------------------------------------------
ANSWER_TTL_SECONDS = 60 * 60 * 24 * 30
ANSWER_KEY_PREFIX = "llm-single-question"
DEFAULT_MODEL_NAME = "rules-v1"

# --- FIXED VALUES: decision and sweep ----------------------------------------
DECISION_THRESHOLD = 0.5
# thresholds are 0.05 + i * 0.05 for i = 0..9 (bit-equal to a numpy arange)
SWEEP_START = 0.05
SWEEP_STEP = 0.05
SWEEP_STEPS = 10
TARGET_RECALL = 0.95

# --- FIXED VALUES: random seed and split fractions ---------------------------
RANDOM_STATE = 42
N_FOLDS = 5

# --- FIXED VALUES: three-valued rule questions (FIXTURES.md, part B) ---------
# question_id: (YES pattern, UNSURE pattern); applied to ASCII-folded text.
RULES = {
    "I01": (r"[#*$&%]{3}", r"[#*$&%]"),
    "I04": (r"[A-Z]{4,}", r"[A-Z]{2}"),
    "I05": (r"[0-9]{3,}", r"[0-9]"),
    "I07": (r"[Ll]icen[cs]e", r"[Cc]opy"),
    "I10": (r" [|] ", r"[@:;]"),
    "I13": (r"\bthe\b", r"\b(die|la|el)\b"),
    "I16": (r"\b(trash|disgusting|loser|stupid|idiot|scum)\b",
            r"\b(worthless|moron|pathetic|clown)\b"),
    "I17": (r"\n[^\n]+\n[^\n]+\n", r"\n"),
    "E01": (r"[A-Za-z0-9._]+@", r"@"),
    "E02": (r"!!", r"!"),
    "E03": (r"^[^\n]{0,40}$", r"^[^\n]{0,80}$"),
    # the other questions of the bank, by words of their own subject
    "I02": (r"\b(NCT|ISRCTN|EudraCT|ACTRN|ChiCTR)[- ]?[0-9]{4,}", r"\b[Rr]egist(ry|ered|ration)\b"),
    "I03": (r"\b[Ii]ntervention(al)?\b", r"\b([Tt]reatment|[Pp]rogram(me)?)\b"),
    "I06": (r"\b[Ss]chizoaffective\b", r"\b[Ss]chizo"),
    "I08": (r"\b[Ss]chizotyp(y|al)\b", r"\b[Ss]chizo"),
    "I09": (r"\b[Pp]ersistent (auditory )?hallucination", r"\b[Hh]allucination"),
    "I11": (r"\b[Aa]kathisia\b", r"\b[Rr]estless"),
    "I12": (r"\b[Tt]ardive dyskinesia\b", r"\b[Dd]yskinesia\b"),
    "I14": (r"\b([Dd]ual diagnos[ie]s|[Cc]omorbid substance)\b", r"\b([Ss]ubstance|[Aa]lcohol|[Cc]annabis) use\b"),
    "I15": (r"\b([Cc]aregivers?|[Cc]arers|[Rr]elatives) of\b", r"\b([Cc]aregivers?|[Cc]arers|[Ff]amil(y|ies))\b"),
    "E04": (r"^\s*[Rr]etract(ion|ed)\b", r"\b[Rr]etract(ion|ed)\b"),
    "E05": (r"\b[Ss]ingle[- ](arm|group)\b", r"\b([Uu]ncontrolled|[Oo]pen[- ]label)\b"),
    "E06": (r"\b([Rr]etrospective|[Oo]bservational) (cohort )?stud(y|ies)\b", r"\b([Rr]egistry|[Cc]ohort)\b"),
    "E07": (r"\b[Qq]ualitative (study|interviews?|methods)\b", r"\b([Ff]ocus groups?|[Ii]nterviews?)\b"),
    "E08": (r"\b[Hh]ealthy (volunteers|subjects|participants)\b", r"\b[Pp]hase (I|1)\b"),
    "E09": (r"\b([Pp]sychotic depression|[Pp]ostpartum psychosis|[Bb]ipolar disorder)\b", r"\b[Bb]ipolar\b"),
    "E10": (r"\b(ECT|rTMS|TMS|tDCS)\b.{0,80}\b([Dd]epress|[Mm]ood)", r"\b(ECT|rTMS|tDCS)\b"),
    "E11": (r"\b([Cc]aregivers?|[Cc]arers) of\b.{0,60}\b([Dd]ementia|[Aa]utis|[Dd]epression)", r"\b([Dd]ementia|[Aa]utis(m|tic))\b"),
    "E12": (r"^\s*(Notice of [Rr]etraction|Retraction [Nn]otice)\b", r"\b[Rr]etraction [Nn]ote\b"),
}

# Strings of which a text must hold one before a pattern can match (YES pattern,
# UNSURE pattern): a cheap look before the regular expression.
RULE_STEMS = {
    "I07": (("icen",), ("opy",)),
    "I10": ((" | ",), ("@", ":", ";")),
    "I16": (("trash", "disgusting", "loser", "stupid", "idiot", "scum"),
            ("worthless", "moron", "pathetic", "clown")),
    "I17": (("\n",), ("\n",)),
    "E01": (("@",), ("@",)),
    "E02": (("!!",), ("!",)),
    "I02": (("NCT", "ISRCTN", "EudraCT", "ACTRN", "ChiCTR"), ("egist",)),
    "I03": (("ntervention",), ("reatment", "rogram")),
    "I06": (("chizoaffective",), ("chizo",)),
    "I08": (("chizotyp",), ("chizo",)),
    "I09": (("ersistent",), ("allucination",)),
    "I11": (("kathisia",), ("estless",)),
    "I12": (("ardive",), ("yskinesia",)),
    "I14": (("ual diagnos", "omorbid"), (" use",)),
    "I15": (("aregiver", "arers", "elatives"), ("aregiver", "arers", "amil")),
    "E04": (("etract",), ("etract",)),
    "E05": (("ingle",), ("ncontrolled", "pen")),
    "E06": (("etrospective", "bservational"), ("egistry", "ohort")),
    "E07": (("ualitative",), ("ocus group", "nterview")),
    "E08": (("ealthy",), ("hase",)),
    "E09": (("depression", "psychosis", "disorder"), ("ipolar",)),
    "E10": (("ECT", "TMS", "tDCS"), ("ECT", "TMS", "tDCS")),
    "E11": (("aregiver", "arers"), ("ementia", "utis")),
    "E12": (("etraction",), ("etraction",)),
}

# --- FIXED VALUES: exclusion reasons, in order (index -> question) ----------
EXCLUSION_REASONS = ["E01", "E02", "E03", "E06", "E07", "E08", "E09", "E10", "E11"]

# --- FIXED VALUES: fixture node table (FIXTURES.md, C.1) ---------------------
# node_id, feature, left_id, right_id, n0, n1   (leaf: feature None, children -1)
FIXTURE_TREE = [
    (0, "I16", 1, 2, 700, 100),
    (1, "I04", 3, 4, 640, 20),
    (2, "I13", 5, 6, 60, 80),
    (3, None, -1, -1, 600, 5),
    (4, None, -1, -1, 40, 15),
    (5, None, -1, -1, 20, 0),
    (6, "I01", 7, 8, 40, 80),
    (7, None, -1, -1, 10, 80),
    (8, None, -1, -1, 30, 0),
]

# --- FIXED VALUES: single-tree grid -----------------------------------------
TREE_GRID = {
    "max_depth": [None],
    "min_samples_split": [2, 3, 4, 5, 10, 20, 30, 35, 40, 45, 50, 60, 70],
    "min_samples_leaf": [1, 2, 3, 5, 10, 20, 50],
    "criterion": ["gini", "entropy", "log_loss"],
    "max_features": [None, "sqrt", "log2"],
}

# --- FIXED VALUES: forest random-search space -------------------------------
FOREST_GRID = {
    "n_estimators": [100, 200, 350, 500],
    "max_depth": [None, 5, 10, 15, 20],
    "min_samples_split": [2, 3, 4],
    "min_samples_leaf": [2, 3, 4, 5],
    "bootstrap": [True, False],
}
FOREST_SEARCH_ITERATIONS = 40

# --- FIXED VALUES: oversampling neighbours ----------------------------------
SMOTE_K = 3
SMOTEN_K = 5
