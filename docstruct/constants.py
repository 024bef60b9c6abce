"""Tables, word lists, patterns and limits that define the results.

Everything here is data. Logic that uses it lives in ``functions`` and ``operators``.
"""

# --- headings -------------------------------------------------------------------

# Normalised heading line -> section key (heading detection and model replies).
SECTION_ALIASES = {
    "abstract": "abstract",
    "introduction": "introduction",
    "background": "introduction",
    "results": "results",
    "discussion": "discussion",
    "results and discussion": "results",
    "methods": "method",
    "method": "method",
    "materials and methods": "method",
    "experimental procedures": "experimental_setup",
    "experimental setup": "experimental_setup",
    "experimental section": "experimental_setup",
    "conclusion": "conclusion",
    "conclusions": "conclusion",
}

# Section lookup by name (search tool): target -> accepted heading lines.
TOOL_HEADINGS = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "background"],
    "method": ["method", "methods", "materials and methods", "methodology"],
    "experiment": ["experiment", "experiments", "experimental setup", "evaluation"],
    "results": ["results", "findings"],
    "discussion": ["discussion"],
    "conclusion": ["conclusion", "conclusions", "summary"],
}

# Order in which sections are offered to a reader under a length budget.
FOCUS_PRIORITY = [
    "abstract",
    "introduction",
    "method",
    "experimental_setup",
    "results",
    "conclusion",
    "figures",
]

# Sections whose text counts as context when figures are ranked.
RANK_CONTEXT_SECTIONS = ["experimental_setup", "results", "conclusion", "figures"]

# Keywords for sections without a heading, in the order in which they are filled.
FALLBACK_KEYWORDS = {
    "method": ["approach", "pipeline", "method", "combine", "neural", "error-correcting"],
    "experimental_setup": ["demonstrated", "sequencing", "evaluated", "experiment", "3.1 mb"],
    "results": ["increase", "improvement", "accuracy", "code rate", "high-noise", "results"],
    "conclusion": ["viable path", "commercial", "broader sense", "conclusion"],
}

# Sections whose absence is reported, in report order.
EXPECTED_SECTIONS = ["abstract", "introduction", "method", "results"]

# --- line patterns (matched on stripped, lower-cased text unless noted) ----------

NOISE_PATTERNS = [
    r"^downloaded from https?://",
    r"^view the article online",
    r"^copyright",
    r"^open access",
    r"^this article is distributed",
    r"^supplementary materials",
    r"^article type",
    r"^\d+\s*$",
    r"^page \d+",
    r"^received\b",
    r"^accepted\b",
    r"^published\b",
]

CITATION_PATTERNS = [r"\bet al\.,", r"\bsci\. adv\.\b", r"\bscience advances\b"]

VENUE_LINE_PATTERNS = [r"volume", r"issue", r"\bnature\b", r"\bsci\. adv\.\b"]

# First match wins; case-insensitive; the match runs to the end of the line.
VENUE_PATTERNS = [
    r"\bSci\. Adv\.\b.*",
    r"\bScience Advances\b.*",
    r"\bNature\b.*",
    r"\bNature [A-Za-z ]+\b.*",
    r"\bCell\b.*",
    r"\barXiv\b.*",
]

AUTHOR_NAME_PATTERN = r"[A-Z][A-Za-z'’\-]+(?:\s+[A-Z][A-Za-z'’\-]+){1,3}"
AUTHOR_MARKS = "*†‡§¶‖"

DOI_PATTERN = r"10\.\d{4,9}/[A-Za-z0-9._;()/:+-]+"
DOI_TRIM = ").,;:"

YEAR_PATTERN = r"(19|20)\d{2}"

FIGURE_START_PATTERN = r"^\s*fig(?:ure)?\.?\s*(\d+[A-Za-z]?)\b"
FIGURE_MENTION_PATTERN = r"\bfig(?:ure)?\.?\s*(\d+[A-Za-z]?)\b"

TITLE_DROP_PATTERNS = [
    r"https?://\S+",
    r"\bArticle\b",
    r"\bCheck for updates\b",
    r"\bdoi[: ]\S+",
]

RESULT_CAPTION_PATTERN = r"(result|increase|accuracy|compare|improvement|performance)"

# --- figures ---------------------------------------------------------------------

# Ordered substring rules for the figure type; the first that hits decides.
FIGURE_TYPE_RULES = [
    ("method_diagram", ["workflow", "pipeline", "framework", "overview", "architecture"]),
    ("line_chart", ["plot", "curve", "trend", "line chart"]),
    ("bar_chart", ["bar", "histogram"]),
    ("table_like_figure", ["table"]),
    ("result_figure", ["compare", "performance", "accuracy", "results", "ablation"]),
]

METRIC_WORDS = ["accuracy", "f1", "precision", "recall", "latency", "speed", "time", "loss"]

COMPARISON_PATTERN = r"\b(?:vs\.?|versus|compared with|against)\b"

PANEL_PATTERN = r"\(([a-z])\)"

# --- limits ----------------------------------------------------------------------

TITLE_MAX_Y = 220.0
TITLE_MIN_SIZE = 12.0
TITLE_SIZE_SLACK = 1.2
TITLE_FALLBACK_BLOCKS = 6
TITLE_BLOCKS = 2
AUTHOR_LINES = 3
ABSTRACT_BLOCKS = 2
ABSTRACT_MIN_CHARS = 80
NOISE_KEPT = 20
KEYWORD_SENTENCES = 4
CAPTION_MAX_GAP = 120.0
CAPTION_MIN_CHARS = 12
FIGURE_REFERENCES = 4
NEIGHBOUR_OFFSETS = [-2, -1, 1, 2]
NEIGHBOUR_MIN_CHARS = 40
NEIGHBOUR_REFERENCES = 2
FIGURE_IMAGES = 4
FIGURES_SELECTED = 4
IMAGE_MIN_SIDE = 40.0
FOCUS_CHARS = 12000
SECTION_CHARS = 4000
ABSTRACT_PREFIX_CHARS = 2500
SEARCH_HITS = 5
SEARCH_WINDOW = 220
LOG_TAIL_LINES = 30
REPLY_CHARS_DRAFT = 120000
REPLY_CHARS_FIGURES = 320
TITLE_CHARS = 200

# (max items, max length) of list fields and max length of text fields, per model reply.
ARTIFACT_LIMITS = {
    "figure_id": 40, "figure_type": 60, "extraction_source": 40, "page_snapshot_path": 240,
    "image_block_paths": (6, 240), "crop_path": 240, "visible_text": (6, 160), "axes": (6, 80),
    "legend_items": (8, 80), "panels": 8, "direct_evidence": (6, 200), "uncertainties": (6, 160),
    "confidence": 40,
}
EVIDENCE_LIMITS = {
    "figure_id": 40, "figure_title_or_caption": 120, "figure_type": 60, "compared_items": (6, 120),
    "metrics_or_axes": (6, 80), "direct_evidence": (6, 200), "referenced_text_spans": (4, 220),
    "semantic_source": 40, "evidence_quality": 40, "uncertainties": (6, 160),
}
ANALYSIS_LIMITS = {
    "figure_id": 320, "figure_title_or_caption": 120, "experiment_focus": 240, "compared_items": (4, 120),
    "metrics_or_axes": (4, 120), "main_observations": (5, 120), "claimed_conclusion": 280,
    "consistency_check": 280, "confidence": 40,
}
DRAFT_LIMITS = {
    "title": 300, "authors": (30, 80), "doi": 120, "venue": 200, "year": 20, "abstract": 5000,
    "section_key": 40, "section_text": 6000, "section_order": (20, 40),
    "discarded_noise": (30, 160), "uncertainties": (20, 160),
    "figure_id": 40, "caption": 800, "page_snapshot_path": 240, "image_block_paths": (6, 240),
    "referenced_text_spans": (6, 260), "caption_block_ids": (8, 40), "reference_block_ids": (12, 40),
}

# --- jobs ------------------------------------------------------------------------

JOB_STATUSES = ["pending", "parsing", "analyzing", "completed", "failed"]
TERMINAL_STATUSES = ["completed", "failed"]

# status -> (percent, states of the four steps upload, parse, analyze, artifact)
JOB_STAGES = {
    "pending": (10, ["active", "pending", "pending", "pending"]),
    "parsing": (35, ["completed", "active", "pending", "pending"]),
    "analyzing": (70, ["completed", "completed", "active", "pending"]),
    "completed": (100, ["completed", "completed", "completed", "completed"]),
    "failed": (100, ["completed", "completed", "failed", "failed"]),
}
JOB_STEPS = ["upload", "parse", "analyze", "artifact"]

# Status changes that a well-behaved job makes.
JOB_TRANSITIONS = [
    ("pending", "parsing"), ("parsing", "analyzing"), ("analyzing", "completed"),
    ("pending", "failed"), ("parsing", "failed"), ("analyzing", "failed"),
]

UPLOAD_KINDS = {".pdf": "pdf", ".txt": "plain_text", ".md": "plain_text"}

PAPER_KEYS = ["metadata", "extracted_notes", "novelty", "strengths", "limitations", "reproducibility"]
