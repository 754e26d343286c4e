"""Parameters of the ready-made queries: word lists that occur in the given texts."""

CATEGORIES = {
    "license": ("license", "copyright"),
    "english": ("the", "and", "that"),
    "german": ("der", "und"),
    "romance": ("que", "les", "los"),
}
MARKERS = ("that", "with", "from", "this", "der", "die", "und", "von", "que", "des", "les", "une", "los")
REDACTED = ("the", "und", "les", "los")
STOP_WORDS = (
    "the", "and", "for", "that", "with", "from", "this", "was", "are", "not", "der", "die", "und", "von", "das", "ein",
    "que", "des", "les", "une", "los", "las", "por", "con", "del",
)
PRODUCT_RULES = {
    "fixings": ("bolt", "nut", "gear"),
    "jewels": ("ring",),
    "gadgets": ("widget", "gizmo"),
}
WANTED_TITLES = ("small ring", "widget", "smal rings", "red", "gren gizmo", "copper teapot of the north")
STYLE_SIGNATURES = ("that", "with", "der", "que")
STYLE_SLANG = ("from", "this", "die", "des")
STYLE_REASONING = ("and", "und", "les", "los")
WINDOW_SIZES = (2, 5, 12, 25, 40)
JUNK_RULES = {
    "mail": r"[a-z0-9.]+@[a-z0-9.]+\.com",
    "junk_suffix": r"###|%%%|\$\$\$|\*\*\*|&&&",
    "license": r"(?i)licen[sc]e|copyright",
    "numbers": r"[0-9]{4,}",
    "pipes": r"\|.*\|",
}
