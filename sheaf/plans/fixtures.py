"""Small inline dimensions that the queries and their SQL twins share; they stand in for agronomy tables."""

from __future__ import annotations

#: source_file, title, source_org, year, authority_score, bias_penalty; four of the twenty sources are unknown on purpose.
SOURCES = [(f"src{i}", f"Title {i}", f"Org {i % 5}", 2010 + i % 14, round(0.6 + 0.02 * i, 2), round(0.05 * (i % 4), 2)) for i in range(16)]
#: Registry keys in order; "src1" also lies in "src10" to "src18".
REGISTRY = (("src19", 0.95, 2022), ("src1", 0.90, 2019), ("src2", 0.88, 2021), ("src3", 0.87, 2020), ("src4", 0.85, 2018), ("src5", 0.92, 2023))
#: Frequent words of the synthetic texts in place of agronomy keywords.
WORDS = ("rewh", "orre", "thatin", "ononst", "inoran", "hehely")
STAGES = {
    "early growth": (("rewh", "orre", "with the"), ("ononst", "hehely")),
    "late growth": (("queoi", "leaux", "thatin"), ("inoran", "menten")),
    "ripening": (("keit", "ung"), ("lichst",)),
    "default": ((), ()),
}
#: Stage of a document's language.
STAGE_OF_LANG = {"en": "Early Growth ", "fr": "growth", "de": "ripening time"}
