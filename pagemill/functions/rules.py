"""The patterns, lists and constants that decide what the text operators do.

They have to be as they are for right results; the logic is elsewhere.
"""

from __future__ import annotations

# --- Page furniture and boilerplate: whole lines (pattern, flags, replacement) ---
HYGIENE_LINES = [
    (r"^\s*\d+/\d+\s*$", "m", ""),
    (r"^\s*Page\s+\d+(?:\s+of\s+\d+)?\s*$", "mi", ""),
    (r"^\s*-\s*\d+\s*-\s*$", "m", ""),
    (r"^\s*\d{1,3}\s*$", "m", ""),
    (r"^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$", "m", ""),
    (r"^\s*VOL\.?\s+\d+\s+ISSUE\s+\d+.*$", "mi", ""),
    (r"^\s*Downloaded from\s+\S+.*$", "mi", ""),
    (r"^\s*Published by\s+(?:American Association|AAAS|Wiley|Elsevier|Springer|Nature).*$", "mi", ""),
    (r"^\s*(?:Copyright|©|\(c\))\s+\d{4}.*$", "mi", ""),
    (r"^\s*All rights reserved\.?\s*$", "mi", ""),
    (r"^\s*Reprints?\s+and\s+[Pp]ermissions?.*$", "m", ""),
    (r"^\s*\*?\s*(?:Corresponding author|To whom correspondence).*$", "mi", ""),
    (r"^\s*[\w.+-]+@[\w-]+\.[\w.-]+\s*$", "m", ""),
    (r"^\s*(?:PHOTOGRAPH|PHOTO|IMAGE|ILLUSTRATION)\s*(?:BY|:)\s*.*$", "mi", ""),
    (r"^\s*(?:A\s+)?[Ss]creenshot\s+(?:from|of)\s+.*$", "m", ""),
    (r"^\s*Fig(?:ure)?\.?\s+\d+.*$", "mi", ""),
    (r"^\s*\d+\s*COMMENTS?\s*$", "mi", ""),
    (r"^\s*(?:SUBSCRIBE|Sign up for our newsletter\b.*)$", "m", ""),
]
# --- The same within lines ---
HYGIENE_INLINE = [
    (r"\(cid:\d+\)", "", ""),
    (r"ISSN\s*[\d\-Xx]+", "i", ""),
    (r"(?:doi|DOI)[:\s]+10\.\d{4,}/\S+", "", ""),
    (r"\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}\s*[AP]M", "i", ""),
    (r"\b\w+\.(?:jpg|jpeg|png|gif|svg|webp)\b", "i", ""),
]
# --- A word broken at a line's end ---
HYPHEN_BREAK = (r"([a-z])-\s*\n\s*([a-z])", "", "$1$2")
# --- A line that occurs this often in a document, and is longer than this, is a running header ---
REPEATED_LINE_TIMES, REPEATED_LINE_LONGER = 3, 3
#: What ends a line besides a newline.
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# --- The heading from which on a document isn't read ---
END_MATTER = (r"^\s*#{0,6}\s*(?:references|external links|see also|further reading|bibliography|notes|footnotes|works cited)\s*$", "mi")

# --- Cleaning of a body, in order ---
CLEAN_BEFORE_HEADINGS = [
    (r"```.*?```", "s", " Code example omitted. "),
    (r"\[?\s*\[edit\]\s*\([^)]*\)\s*\]?", "i", ""),
    (r"\[edit\]", "i", ""),
    (r"\(#[^)\s]*\)", "", ""),
    (r"<sup\b[^>]*>.*?</sup>", "si", ""),
    (r"</?(?:sub|span|em|strong|i|b|u|small|br|a)\b[^>]*/?>", "i", ""),
    (r"\\([\[\]])", "", "$1"),
    (r"<https?://[^>]+>", "", ""),
    (r"!\[[^\]]*\]\([^)]*\)", "", ""),
    (r"\[\^?(?:\d+|[a-z]|note \d+)\]", "i", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "", "$1"),
    (r"https?://\S+", "", ""),
    (r"^\s*\|.*\|\s*$", "m", ""),
    (r"^(?:figure|fig\.|photo|image|photograph|illustration|source|credit|caption)\b[^\n]{0,200}$", "mi", ""),
]
INLINE_CODE = (r"`([^`]*)`", "", "$1")
EMPHASIS = (r"(\*{1,3}|_{1,3})(\S(?:.*?\S)?)\1", "", "$2")
EMPHASIS_MARKS = ["***", "**", "*", "___", "__", "_"]
CLEAN_AFTER_EMPHASIS = [
    (r"\*{2,}", "", ""),
    (r"^>\s?", "m", ""),
    (r"^\s*(?:[-*+]|\d+[.)])\s+", "m", ""),
    (r"\[\s*\]", "", ""),
    (r"\[(\w{1,12})\]", "", "\x02$1\x01"),
    (r"[\[\]]", "", ""),
    (r"\x02", "", "["),
    (r"\x01", "", "]"),
    (r"[ \t]{2,}", "", " "),
    (r"\n{3,}", "", "\n\n"),
]

# --- Signs without case of which a text has to hold one for a rule to match ---
SIGNS = {
    HYGIENE_LINES[0][0]: ["/"],
    HYGIENE_LINES[2][0]: ["-"],
    HYGIENE_LINES[4][0]: ["/"],
    HYGIENE_LINES[12][0]: ["@"],
    HYGIENE_INLINE[0][0]: ["(cid:"],
    HYGIENE_INLINE[3][0]: ["/"],
    CLEAN_BEFORE_HEADINGS[0][0]: ["```"],
    CLEAN_BEFORE_HEADINGS[1][0]: ["["],
    CLEAN_BEFORE_HEADINGS[2][0]: ["["],
    CLEAN_BEFORE_HEADINGS[3][0]: ["(#"],
    CLEAN_BEFORE_HEADINGS[4][0]: ["<"],
    CLEAN_BEFORE_HEADINGS[5][0]: ["<"],
    CLEAN_BEFORE_HEADINGS[6][0]: ["\\[", "\\]"],
    CLEAN_BEFORE_HEADINGS[7][0]: ["<http"],
    CLEAN_BEFORE_HEADINGS[8][0]: ["!["],
    CLEAN_BEFORE_HEADINGS[9][0]: ["["],
    CLEAN_BEFORE_HEADINGS[10][0]: ["]("],
    CLEAN_BEFORE_HEADINGS[11][0]: ["http"],
    CLEAN_BEFORE_HEADINGS[12][0]: ["|"],
    INLINE_CODE[0]: ["`"],
    CLEAN_AFTER_EMPHASIS[0][0]: ["**"],
    CLEAN_AFTER_EMPHASIS[1][0]: [">"],
    CLEAN_AFTER_EMPHASIS[3][0]: ["["],
    CLEAN_AFTER_EMPHASIS[4][0]: ["["],
    CLEAN_AFTER_EMPHASIS[5][0]: ["[", "]"],
    CLEAN_AFTER_EMPHASIS[6][0]: ["\x02"],
    CLEAN_AFTER_EMPHASIS[7][0]: ["\x01"],
    CLEAN_AFTER_EMPHASIS[8][0]: ["  ", "\t"],
    CLEAN_AFTER_EMPHASIS[9][0]: ["\n\n\n"],
}

# --- What a cleaned text should not hold (name, pattern, flags) ---
LINT = [
    ("html tag", r"</?[a-z][a-z0-9]*\b[^>]*>", "i"),
    ("bracket residue", r"[\[\]]", ""),
    ("url", r"https?://|www\.", "i"),
    ("backslash escape", r"\\[\[\]()*_#]", ""),
    ("anchor husk", r"\(#[^)\s]*\)", ""),
    ("markdown emphasis", r"(?:\*{1,3}|_{2,3})\S", ""),
    ("markdown heading", r"^#{1,6}\s", "m"),
    ("code fence", r"```", ""),
    ("citation marker", r"\bcite[_-]?(?:note|ref)", "i"),
]
LINT_SIGNS = {"html tag": ["<"], "bracket residue": ["[", "]"], "backslash escape": ["\\"], "anchor husk": ["(#"], "markdown emphasis": ["*", "__"], "markdown heading": ["#"], "code fence": ["```"]}
AUTHOR_BRACKET = (r"\[(\w{1,12})\]", "", "$1")
REPEATED_PARAGRAPH_CHARS = 200

# --- Lines of a text layer ---
TERMINAL = ".!?\"”’):"
SHORT_LINE_RUN, SHORT_LINE_CHARS = 3, 32
LIGATURES = ["ffi", "ffl", "ff", "fi", "fl"]
MISSING_GLYPH = "\ufffe\uffff\ue000-\uf8ff"
DIACRITIC_RESIDUE = "\u00af\u02d9\u02d8\u00b4\u0060\u005e\u00a8\u02dc"
NUMBERED_HEADING = r"^\s*(?:(?:chapter|section|part)\s+)?(?:\d+(?:\.\d+){0,2}\.?|[IVXLC]{1,6}\.)\s+(\S.{0,78})$"
AFFILIATION_MARKS, BULLETS = "\u2217\u2020\u2021*", "\u00b7\u2022"

# --- Sentences ---
ABBREVIATION = r"\b(?:e\.g|i\.e|et al|etc|vs|cf|viz|approx|resp|Fig|Figs|Eq|Eqs|Sec|Ch|Chap|Vol|No|Nos|pp?|Dr|Mr|Mrs|Ms|Prof|Sr|Jr|St|Mt|Inc|Ltd|Co|Corp|U\.S|U\.K|Ph\.D|a\.m|p\.m|[A-Z])\.$"

# --- Sections and chapters ---
MIN_CHAPTER_CHARS, MAX_CHAPTERS, CHAPTER_TITLE_CHARS = 700, 20, 60
LEAD = "End of summary. The full article begins now."

# --- Titles ---
JUNK_PREFIXES = ["microsoft word - ", "microsoft powerpoint - ", "untitled", "document", "scan", "img_", "image", "download", "final", "draft", "copy of "]
JUNK_SUFFIXES = [".pdf", ".doc", ".docx", ".tex", ".pptx", ".txt"]
UNSAFE_IN_NAMES = r"[\\/:*?\"<>|#\^\[\]]+"
SITE_SUFFIX_WORDS = 3
GENERIC_CHAPTERS = ["summary", "full article", "introduction", "contents"]

# --- OCR ---
MIN_PAGE_CHARS, OCR_CHARS_PER_PAGE, REPEAT_WINDOW, HEADER_CHARS = 24, 1800, 160, 60
LATEX = [(r"\$?\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}\$?", "", "$1/$2"), (r"\$([^$\n]{1,40})\$", "", "$1")]
IMAGE_SUFFIXES = ["png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "gif"]

# --- Scenes of covers, in order ---
_QUOTED = "(?:'[^']*'|\"[^\"]*\"|\u2018[^\u2019]*\u2019|\u201c[^\u201d]*\u201d)"
SCENE_LETTERED = r"(?:signs?|banners?|placards?|labels?|plaques?|posters?|captions?|titles?|text|words?|letters?|lettering|inscriptions?|headlines?)"
SCENE_HELD = r"(?:holding|carrying|displaying|showing|bearing|with|under|beneath)"
#: Possessive where nothing behind a loop could take anything back (Java matches other loops over groups by recursion), and white
#: space is only tried where it begins; `rx.plain` takes both marks away for dialects that don't need them.
SCENE = [
    (r"(?<!\s)\s*+\b(?:labell?ed|reading|reads|says|saying|titled|marked|inscribed\s+with|with\s+the\s+(?:words?|text))\s*+" + _QUOTED + r"(?:(?:\s*+(?:,|and|or))++\s*+" + _QUOTED + r")*+", "i", ""),
    (r"(?<!\s)\s*+" + _QUOTED, "", ""),
    (r"(?<!\s)\s*+\b(?:labell?ed|titled|that\s+(?:says|reads)|inscribed\s+with|with\s+the\s+(?:words?|text))\b[^,.;]*+", "i", ""),
    (r"(?<!\s)\s*+\b" + SCENE_HELD + r"\s++(?:(?!" + SCENE_HELD + r"\b)[\w-]++\s++){0,3}?" + SCENE_LETTERED + r"\b", "i", ""),
    (r"(?<!\s)\s++([,.;])", "", "$1"),
    (r"(?:,\s*+){2,}+", "", ", "),
    (r"\s{2,}", "", " "),
]
#: What ends a quote, and for the third and the fourth rule words of which a text that it matches holds one.
QUOTE_ENDS = "'\"\u2019\u201d"
SCENE_WORDS = [
    ["label", "titled", "says", "reads", "inscribed", "word", "text"],
    ["sign", "banner", "placard", "label", "plaque", "poster", "caption", "title", "text", "word", "letter", "inscription", "headline"],
]

# --- Chat ---
ANGLE_URL, BARE_URL = r"<(https?://[^|>\s]+)(?:\|[^>]*)?>", r"https?://\S+"
CANCEL_WORDS = ["cancel", "stop", "abort", "nevermind", "nvm"]
HELP_WORDS = ["help", "?", "usage", "how does this work?"]

# --- Calibration and estimates ---
STAGES = ["ocr", "summarize_single", "summarize_map", "audio"]
ALPHA, MOST_LOG_RATIO, FACTOR_MIN, FACTOR_MAX, SPREAD_K = 0.1, 2.5, 0.25, 8.0, 1.0
SINGLE_BASE_S, SINGLE_S_PER_CHAR, CHUNK_S, OCR_PAGE_S, AUDIO_S_PER_CHAR = 60.0, 0.02, 480.0, 190.0, 1 / 30

# --- Settings that chat may change ---
FROZEN_KEYS = ["tts_voice", "tts_enabled", "cover_style"]
ALLOWED_KEYS = ["tts_voice", "tts_enabled", "note_format", "cover_style"]

# --- Commands and the settings they set ---
COMMANDS = {"voice": "tts_voice", "format": "note_format", "cover": "cover_style", "tts": "tts_enabled"}
NOTE_FORMATS = ["pdf", "md", "docx", "none"]
COVER_STYLES = {
    "flat": "flat minimalist illustration, limited color palette, clean shapes",
    "storybook": "detailed storybook illustration, ink and color",
    "painterly": "painterly oil painting, visible brush strokes",
    "watercolor": "soft watercolor painting, paper texture",
    "woodcut": "linocut woodcut print, bold lines, two colors",
    "poster": "vintage travel poster style, bold flat colors",
}
FALLBACK_STYLE = "flat"
COVER_CHOICES = ["auto", "random", *COVER_STYLES, "off"]

# --- Voices ---
LANGUAGES = {"a": "American English", "b": "British English", "e": "Spanish", "f": "French", "h": "Hindi", "i": "Italian", "j": "Japanese", "p": "Portuguese", "z": "Chinese"}
GENDERS = {"f": "female", "m": "male"}
KEPT_VOICES = ["af_", "am_", "bf_", "bm_"]
