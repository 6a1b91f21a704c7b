"""Text expressions: cleaning, tokenising, sentence splitting, tags. All are built-in functions, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Noise patterns, removed case-insensitively in this order.
NOISE = (
    r"Tamil Nadu Agricultural University.*?\n",
    r"Kerala Agricultural University.*?\n",
    r"TNAU.*?Coimbatore.*?\n",
    r"National Centre for Organic.*?\n",
    r"Package of Practices.*?\n",
    r"Organic Package.*?Crops\s*\n",
    r"^\s*\d{1,3}\s*$",
    r"Source\s*:.*?\n",
    r"Published by.*?\n",
    r"\x0c",
    r"\.{4,}",
)
# Literal replacements after cleaning.
LITERALS = (("ha\\.", "ha."), ("@ ", "at "), ("Oo ", "0 "))
# Stop words of the index, and of queries at the gate.
STOP_WORDS = (
    "the a an and or but in on at to for of with is are was were be been being have has had do does did will would could should "
    "may might shall can need this that these those it its from by as if then than so also both each more most other into through "
    "during before after above per about up out over under"
).split()
GATE_STOP_WORDS = "the a an and or in on at to for of with is are was be this that it from by as per".split()
# Crops that are tagged, in order.
CROPS = (
    "rice wheat maize cotton sugarcane tomato chilli brinjal onion potato mango banana coconut cashew tapioca bittergourd cucumber "
    "pumpkin okra ginger turmeric cardamom pepper groundnut soybean sunflower mustard tea coffee rubber arecanut jasmine marigold rose orchid"
).split()
# Section headers that begin a chunk, a heading in capitals, a numbered heading.
SECTION_HEADERS = (
    r"Pest[s]?|Disease[s]?|Varieties|Variety|Manur(e|ing)|Fertiliz(er|ation)|Nutrient|Irrigation|Water\s*Management|Harvesting|Harvest|"
    r"Post.?Harvest|Nursery|Sowing|Planting|Transplanting|After\s*Cultivation|Inter.?Crop|Plant\s*Protection|Weed\s*Control|"
    r"Soil\s*Preparation|Land\s*Preparation|Seed\s*Treatment|Crop\s*Protection|Storage|Processing|Yield|Economics|Climate|Season|Package\s*of\s*Practices"
)
CAPITALS = r"^[A-Z][A-Z\s\(\)]{6,}$"
NUMBERED = r"^\d+[\.\)]\s+[A-Z]"

#: Word characters and white space, spelled out so that every engine reads them alike.
W = r"[\p{L}\p{N}_]"
#: Flags that make Java read patterns as Python does: multi-line, only \n ends a line, Unicode classes and case.
PY_MULTILINE = "(?imdU)"
PY = "(?dU)"


#: Characters that are white space to every engine here.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """All white space off both ends."""
    return F.trim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Noise out, hyphenated breaks joined, units joined, white space evened out, literal fixes, stripped; null becomes the empty text."""
    c = F.coalesce(c, F.lit(""))
    for pattern in NOISE:
        c = F.regexp_replace(c, PY_MULTILINE + pattern, " ")
    c = F.regexp_replace(c, PY + r"-\s*\n\s*", "")
    c = F.regexp_replace(c, PY + rf"(?<!{W})({W}++)\s*+/\s*+({W}++)", "$1/$2")
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    for wrong, right in LITERALS:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return strip(c)


def searched(c: Column) -> Column:
    """The text that search tokens are read from: lower case, ``a/b`` as ``a_per_b``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(low, F.lit("/")), F.regexp_replace(low, f"(?<!{W})({W}++)/({W}++)", "$1_per_$2")).otherwise(low)


def tokens(c: Column, stop_words=STOP_WORDS) -> Column:
    """Search tokens: lower case, ``a/b`` as ``a_per_b``, ASCII letters, digits and underscores, no stop words, two chars at least."""
    words = F.regexp_extract_all(searched(c), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words))  # a hash set: the list is one of literals


def sentences(c: Column, least: int = 15, most: int | None = None) -> Column:
    """Default splitter: after ``. ! ?`` and white space, or at line ends; stripped, longer than ``least``. ``most`` cuts the text as a splitter with a window would, by default all of it is read."""
    c = F.coalesce(c, F.lit(""))
    c = F.substring(c, 1, most) if most else c
    parts = F.split(F.regexp_replace(c, r"([.!?])[ \t\r\n]+", "$1\n"), r"\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(" \t\r"))), lambda s: F.length(s) > least)


def answer_sentences(c: Column) -> Column:
    """Sentences of an answer: no headings, bold lines or table rows, longer than ten."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda x: strip(x))
    return F.filter(parts, lambda s: (F.length(s) > 10) & ~s.startswith("#") & ~s.startswith("**") & ~s.contains("|"))


def is_hard_boundary(c: Column) -> Column:
    """Sentences that always begin a chunk."""
    return strip(c).rlike(f"(?i:^({SECTION_HEADERS}))|{CAPITALS}|{NUMBERED}")


def crop_tags(c: Column, names=CROPS) -> Column:
    """Names that occur in the lower-cased text, as substrings, in order."""
    # bound by the outer function: inside the filter the text would be lower-cased for every name
    found = lambda low: F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(low, n))
    return F.get(F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), found), 0)


def preview(c: Column, size: int = 200) -> Column:
    return F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" "))
