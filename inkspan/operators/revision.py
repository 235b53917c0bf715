"""Revision help: plain wordings for stock phrases, protected spans, and the edits that remain."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.udfs import apply_edits, find_spans

# Suggestions by stock phrase, those in brackets calling for the writer's judgment; spans that no edit touches.
SUGGESTED = {
    "delve": "look into", "delve into": "look into", "tapestry": "mix (or cut the word)", "vibrant tapestry": "mix (or cut the phrase)",
    "testament to": "shows", "pivotal role": "important role", "seamless integration": "smooth integration", "holistic approach": "overall approach",
    "multifaceted": "complex", "in the realm of": "in", "the landscape of": "the field of", "a myriad of": "many", "a plethora of": "many",
    "it is important to note": "(cut the phrase; state the fact directly)", "it is worth noting": "(cut the phrase; state the fact directly)",
    "plays a crucial role": "matters for", "foster innovation": "encourage innovation", "game changer": "(name the specific effect instead)",
    "leverage": "use", "utilize": "use", "robust": "reliable", "comprehensive": "thorough", "streamline": "simplify",
}
PROTECTED = {
    "quotation": r'["“][^"”\n]{1,2000}["”]',
    "inline code": r"`[^`\n]+`|```[\s\S]*?```",
    "URL or DOI": r"(?i)https?://\S+|\bdoi:\s*10\.\d{4,9}/\S+|\b10\.\d{4,9}/\S+",
    "LaTeX command or equation": r"\\(?:cite|ref|eqref|url|doi)\{[^}]+\}|\$[^$\n]+\$",
    "citation": r"(?i)\([^()\n]{0,100}\b(?:19|20)\d{2}[a-z]?[^()\n]{0,100}\)|\[\d+(?:\s*[-,]\s*\d+)*\]",
    "reference section": r"(?im)^\s*(?:references|bibliography|works cited)\s*$[\s\S]*",
}
LENGTHS = ("any", "same", "no_increase", "shorter")


def cleanup(docs: DataFrame, length: str = "any", protected: Sequence[str] = (), most: int = 12) -> DataFrame:
    """The rows of `docs` with edits, refused (edits with the reason) and revised, the text after the edits.

    The first `most` stock phrases of a text are looked at; those whose
    suggestion is in brackets are left to the writer. An edit is refused
    inside protected text, which holds the terms `protected` too, and if the
    change of its words doesn't fit `length`. Of overlapping edits the first
    is made, of those at one place the longest ("delve into" before "delve").
    A null text has no edits.
    """
    if length not in LENGTHS:
        raise ValueError(f"length must be one of {LENGTHS}")
    terms = {f"protected term: {t.strip()}": rf"(?i)(?<!\w){re.escape(t.strip())}(?!\w)" for t in protected if t.strip()}
    found = docs.withColumn("__found", find_spans(F.col("text"), {w: rf"(?i)\b{w}\b" for w in SUGGESTED}))
    found = found.withColumn("__kept", find_spans(F.col("text"), PROTECTED | terms))
    plain = F.create_map(*(F.lit(x) for pair in SUGGESTED.items() for x in pair))
    fits = {"any": lambda n: F.lit(True), "same": lambda n: n == 0, "no_increase": lambda n: n <= 0, "shorter": lambda n: n < 0}[length]

    def edit(s):
        inside = F.filter("__kept", lambda p: (p["start"] < s["end"]) & (p["end"] > s["start"]))
        new = plain[s["kind"]]
        more = F.regexp_count(new, F.lit(r"\w+")) - F.regexp_count(s["text"], F.lit(r"\w+"))
        reason = F.coalesce(F.get(F.transform(inside, lambda p: p["kind"]), F.lit(0)), F.when(~fits(more), f"excluded by {length} length mode"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("original"), new.alias("replacement"), reason.alias("reason"), more.alias("word_delta"))

    offered = F.filter(F.transform(F.slice("__found", 1, most), edit), lambda e: ~e["replacement"].startswith("("))
    rows = found.withColumn("__edits", offered)
    rows = rows.withColumn("edits", F.filter("__edits", lambda e: e["reason"].isNull())).withColumn("refused", F.filter("__edits", lambda e: e["reason"].isNotNull()))
    changes = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    return rows.withColumn("revised", apply_edits(F.col("text"), changes)).drop("__found", "__kept", "__edits")
