"""Text normalisation as native Column expressions (no Python workers).

Character classes are spelled out because Java's ``\\w`` and ``\\s`` are ASCII-only
while review text is not: a word character is a letter, a number or ``_``; white
space is every character Unicode calls a separator plus the ASCII controls.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space, for trimming by character set (linear, no regex).
WHITESPACE = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
ASCII_WHITESPACE = " \t\n\r\x0b\x0c"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Pieces for use inside a regex character class.
WS = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
PUNCT = r"!\"#$%&'()*+,\-./:;<=>?@\[\]\^_`{|}~"  # every ASCII mark but the backslash
# Union of the pictograph ranges: everything from U+24C2 up, and four single symbols.
PICTOGRAPH = r"\x{24C2}-\x{10FFFF}\x{200D}\x{231A}\x{23CF}\x{23E9}"

TAG = r"<[^>]+>"

# Abbreviation -> expansion.
ABBREVIATIONS: dict[str, str] = {
    "ko": "không", "k": "không", "khong": "không", "kg": "không", "hok": "không",
    "dc": "được", "đc": "được", "đk": "được", "r": "rồi", "vs": "với",
    "j": "gì", "bt": "bình thường", "mk": "mình", "mik": "mình",
    "cx": "cũng", "bn": "bạn", "b": "bạn", "tks": "cảm ơn", "thanks": "cảm ơn",
    "nchung": "nói chung", "nhìu": "nhiều", "nhieu": "nhiều",
    "cty": "công ty", "nt": "nhắn tin", "sp": "sản phẩm",
    "i": "giống", "sz": "cỡ", "sdt": "số điện thoại",
    "ok": "tốt", "oke": "tốt", "okey": "tốt", "okie": "tốt",
    "okeyy": "tốt", "okiee": "tốt", "thik": "thích",
    "thix": "thích", "ib": "nhắn tin", "ibx": "nhắn tin",
    "inbox": "nhắn tin", "inb": "nhắn tin", "inbx": "nhắn tin",
    "mn": "mọi người", "mng": "mọi người",
    "sr": "xin lỗi", "sorry": "xin lỗi", "éo": "không", "kh": "không",
    "rep": "trả lời", "ship": "giao hàng", "h": "giờ",
    "lm": "làm", "rùi": "rồi", "tl": "trả lời",
}

# Substring replacements, applied in this order.
TYPO_REPLACEMENTS: list[tuple[str, str]] = [
    ("ko ", "không "), ("k ", "không "), ("hok ", "không "),
    ("dc ", "được "), ("đc ", "được "), ("dk ", "được "),
    ("vs ", "với "), ("j ", "gì "),
    ("sp ", "sản phẩm "), ("trl ", "trả lời "),
    (" r ", " rồi "), (" ạ ", " "), (" a ", " "),
    ("lun", "luôn"), ("nka", "nha"), ("nhé", "nha"),
    (". ", " . "), (", ", " , "),
]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim every kind of Unicode white space from both ends."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def drop_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), TAG, "")


def collapse_ws(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"[{WS}]+", " ")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(strip_ws(c) == "", F.lit(True))


def clean_basic(c: Column | str) -> Column:
    """Drop tags, blank out marks, lower, trim; inner runs of spaces stay; null gives ''."""
    marks_out = F.regexp_replace(drop_tags(c), f"[^{WORD}{WS}]", " ")
    return F.coalesce(strip_ws(F.lower(marks_out)), F.lit(""))


def clean_stream(c: Column | str) -> Column:
    """Lower, drop tags, one space between words, trim; null gives ''."""
    return F.coalesce(strip_ws(collapse_ws(drop_tags(F.lower(_col(c))))), F.lit(""))


def strip_emoji(c: Column | str) -> Column:
    """Replace each run of pictographs by one space."""
    return F.regexp_replace(_col(c), f"[{PICTOGRAPH}]+", " ")


def collapse_repeats(c: Column | str) -> Column:
    """Collapse any character repeated in a row to one; line feeds are left alone."""
    return F.regexp_replace(_col(c), r"(?d)(.)\1+", "$1")


def punct_spacing(c: Column | str) -> Column:
    """Put spaces around marks that touch a word."""
    both = F.regexp_replace(
        _col(c), f"([{WORD}])[{WS}]*([{PUNCT}])[{WS}]*([{WORD}])", "$1 $2 $3"
    )
    return F.regexp_replace(both, f"([{WORD}])[{WS}]*([{PUNCT}])", "$1 $2")


def punct_collapse(c: Column | str) -> Column:
    """Keep only the first mark of a run of two or more."""
    return F.regexp_replace(_col(c), f"([{PUNCT}])[{PUNCT}]+", "$1")


def strip_outer(c: Column | str) -> Column:
    """Trim white space, then marks and ASCII white space, from both ends."""
    return F.btrim(strip_ws(c), F.lit(PUNCTUATION + ASCII_WHITESPACE))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; a blank text gives an empty array."""
    return F.filter(F.split(strip_ws(c), f"[{WS}]+"), lambda w: w != "")


def expand_abbrev(c: Column | str, table: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """Replace whole words found in ``table`` (looked up lower-cased), join by one space."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def expand(w: Column) -> Column:
        # A hashed set answers "is it an abbreviation" for the many words that are none.
        return F.when(F.lower(w).isin(*table), F.element_at(lookup, F.lower(w))).otherwise(w)

    return F.array_join(F.transform(words(c), expand), " ")


def normalise_full(c: Column | str, table: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """The whole normaliser: case, pictographs, repeats, marks, spaces, abbreviations."""
    t = strip_emoji(F.lower(_col(c)))
    t = punct_collapse(punct_spacing(collapse_repeats(t)))
    return expand_abbrev(collapse_ws(strip_outer(t)), table)


def normalise_typos(
    c: Column | str,
    replacements: Sequence[tuple[str, str]] = TYPO_REPLACEMENTS,
    passes: int = 2,
) -> Column:
    """Lower, trim, then ordered substring replacements; the rules engine runs two passes."""
    t = _col(c)
    for _ in range(passes):
        t = strip_ws(F.lower(t))
        for old, new in replacements:
            t = F.replace(t, F.lit(old), F.lit(new))
    return t


def signature(c: Column | str) -> Column:
    """Fuzzy identity of a text: lower-cased letters, numbers and ``_`` only."""
    return F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), f"[^{WORD}]", "")


def is_junk(c: Column | str, threshold: int = 25) -> Column:
    """No space at all and longer than ``threshold`` characters."""
    return ~F.contains(_col(c), F.lit(" ")) & (F.length(_col(c)) > threshold)


def truncate_text(c: Column | str, limit: int = 100) -> Column:
    """One-line preview: line feeds to spaces, long text cut to ``limit`` with an ellipsis."""
    t = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def render_prompt(template: str, review: Column | str, aspects: Sequence[str]) -> Column:
    """Fill ``{review}`` and ``{aspects}`` of a prompt template."""
    listed = ", ".join(f'"{a}"' for a in aspects)
    parts = template.replace("{aspects}", listed).split("{review}")
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.coalesce(_col(review), F.lit("")))
        pieces.append(F.lit(part))
    return F.concat(*pieces)


# ---------------------------------------------------------------- URLs and times

# Item-id patterns, tried in order.
ITEM_ID_CRAWL = [
    r"-i(\d+)-s", r"-i(\d+)\.", r"-i(\d+)$", r"-i(\d+)\?", r"itemId=(\d+)",
    r"/i(\d+)\?", r"/i(\d+)$", r"products/.*?-(\d+)\.html",
]
ITEM_ID_SEARCH = [
    r"-i(\d+)-s", r"-i(\d+)\.", r"-i(\d+)$", r"itemId=(\d+)",
    r"/i(\d+)\?", r"/i(\d+)$", r"products/.*?-(\d+)\.html",
    r"/(\d{6,})[-\.]", r"/(\d{6,})\?",
]
ITEM_ID_BROWSER = [r"-i(\d+)-s", r"itemId=(\d+)", r"/(\d+)\.html"]
ITEM_ID_SIMPLE = [r"-i(\d+)"]
ANY_LONG_NUMBER = r"(\d{6,})"


def item_id(
    url: Column | str,
    patterns: Sequence[str] = tuple(ITEM_ID_CRAWL),
    any_long_number: bool = True,
    missing: str | None = None,
) -> Column:
    """First capture of the first matching pattern, else the first long number, else ``missing``."""
    tried = [*patterns, ANY_LONG_NUMBER] if any_long_number else list(patterns)
    found = [F.nullif(F.regexp_extract(_col(url), p, 1), F.lit("")) for p in tried]
    return F.coalesce(*found, F.lit(missing))


def sku_id(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(url), r"-s(\d+)", 1), F.lit(""))


def clean_url(url: Column | str) -> Column:
    """Trim, then double quotes, then single quotes from both ends."""
    return F.btrim(F.btrim(strip_ws(url), F.lit('"')), F.lit("'"))


def with_scheme(url: Column | str) -> Column:
    """Scheme-relative addresses get https."""
    u = F.coalesce(_col(url), F.lit(""))
    return F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)


def epoch_ms_to_ts(c: Column | str) -> Column:
    """Epoch milliseconds (number or text) to a timestamp; anything else gives null."""
    return F.timestamp_millis(_col(c).try_cast("bigint"))
