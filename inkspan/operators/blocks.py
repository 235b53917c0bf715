"""Texts to typed blocks with offsets, as expressions of one row: a text is split at blank lines, and what its classifier remembers
(an open code fence, a reference header that went before) is a running maximum over its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.scans import bound, scanned, starts
from inkspan.plans.dialect import BOUNDARY

GAP = r"\n\s*\n"
FENCE = "```"
# What a block's first words say.
REFERENCES = r"(?i)^(?:#{1,6}\s*)?(?:references|works cited|bibliography)[:#*\s]*\z"
LISTED, QUOTED, HEADED = r"^(?:[-*+] |\d+[.)] )", r"^>\s", r"^#{1,6}\s+"
FORMULA = "[Mathematical Formula]"
LISTS_SOURCES = rf"(?i)^(?:references|works cited|bibliography){BOUNDARY}"
ELIGIBLE, EXCLUDED = ("paragraph", "heading", "list_item", "table_cell", "caption"), ("quotation", "reference", "code", "template")
KEPT_KINDS = ("paragraph", "heading", "list_item", "quotation")


def parts(text: Column) -> Column:
    """Place (from 0), start and text of each part between blank lines, without spaces around it; empty ones too."""
    lead = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
    value = lambda p: F.regexp_replace(F.regexp_replace(p, r"^\s+", ""), r"(?<!\s)\s++\z", "")

    def placed(pieces: Column, gaps: Column) -> Column:
        lengths = F.zip_with(pieces, gaps, lambda p, g: F.length(p) + F.coalesce(F.length(g), F.lit(0)))
        return bound(starts(lengths), lambda at: F.transform(pieces, lambda p, i: F.struct(i.alias("place"), (F.get(at, i) + lead(p)).alias("start"), value(p).alias("text"))))

    whole = F.coalesce(text, F.lit(""))
    return bound(F.split(whole, GAP, -1), lambda pieces: placed(pieces, F.regexp_extract_all(whole, F.lit(GAP), F.lit(0))))


def plain_blocks(text: Column) -> Column:
    """Blocks of a plain text: place from 1, kind (quotation, reference or paragraph), text and start; heading level and share of bold letters are unknown."""
    kind = lambda t: F.when(F.substring(t, 1, 1).isin(">", '"', "“"), "quotation").when(t.rlike(LISTS_SOURCES), "reference").otherwise("paragraph")
    full = F.filter(parts(text), lambda p: p["text"] != "")
    return F.transform(
        full, lambda p, i: F.struct((i + 1).alias("block_no"), kind(p["text"]).alias("kind"), p["text"], p["start"], F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("double").alias("bold_share"))
    )


def typed_blocks(text: Column, format: Column) -> Column:
    """Blocks of a text extracted from a file of `format` (txt, md, tex, ipynb, ...): block_no, kind, text, start, heading_level, bold_share.

    Behind a block that opens a code fence everything is code until a block
    holds the closing one; behind a heading that announces references
    everything but code is one. A block_no counts empty parts too. start is
    the place in `text`; a null text has no blocks.
    """
    md, formulas = format == "md", format.isin("tex", "ipynb")
    fenced = lambda t: md & t.startswith(FENCE)
    # A block that begins with a fence leaves code open if it has an odd number of them; any other with a fence closes it.
    fence = lambda t: F.when(fenced(t), F.regexp_count(t, F.lit(FENCE)) % 2).when(F.contains(t, F.lit(FENCE)), 0)
    most = lambda a, b: F.greatest(a, b)
    marks = lambda t: F.length(F.regexp_extract(t, "^#*", 0))

    def typed(found: Column, inside: Column) -> Column:
        head = lambda p, i: ~(fenced(p["text"]) | inside_at(i)) & p["text"].rlike(REFERENCES)
        inside_at = lambda i: F.get(inside, i) % 2 == 1

        def block(p: Column, i: Column, behind: Column) -> Column:
            t, announces = p["text"], head(p, i)
            kind = (
                F.when(fenced(t) | inside_at(i), "code").when(announces, "heading").when(F.get(behind, i) == 1, "reference").when(md & t.rlike(HEADED), "heading")
                .when(t.rlike(LISTED), "list_item").when(t.rlike(QUOTED), "quotation").when(t.startswith(FENCE) | (formulas & F.contains(t, F.lit(FORMULA))), "code").otherwise("paragraph")
            )
            level = F.when(kind == "heading", F.greatest(marks(t), F.lit(1)))
            return F.struct((p["place"] + 1).alias("block_no"), kind.alias("kind"), t.alias("text"), p["start"].alias("start"), level.alias("heading_level"), F.lit(None).cast("double").alias("bold_share"))

        announced = scanned(F.transform(found, lambda p, i: F.when(head(p, i), 1).otherwise(0)), F.lit(0), most)
        return bound(announced, lambda behind: F.transform(found, lambda p, i: block(p, i, behind)))

    # The last block with a fence before each, as twice its number and whether it leaves code open.
    last = lambda found: scanned(F.transform(found, lambda p, i: F.coalesce(2 * (i + 1) + fence(p["text"]), F.lit(0))), F.lit(0), most)
    full = F.filter(parts(text), lambda p: p["text"] != "")
    return bound(full, lambda found: bound(last(found), lambda inside: typed(found, inside)))


def block_rows(docs: DataFrame, blocks: Column, key: str = "doc_id") -> DataFrame:
    """A row a block: key, block_no, kind, text, heading_level, its place in the source (source_start, source_end) and in all blocks two line breaks apart (start, end)."""
    listed = bound(blocks, lambda b: F.arrays_zip(b.alias("b"), starts(F.transform(b, lambda x: F.length(x["text"]) + 2)).alias("at")))
    rows = docs.select(key, F.explode(listed).alias("x")).select(key, F.col("x.b").alias("b"), F.col("x.at").alias("start"))
    size = F.length("b.text")
    return rows.select(key, "b.block_no", "b.kind", "b.text", "b.heading_level", F.col("b.start").alias("source_start"), (F.col("b.start") + size).alias("source_end"), "start", (F.col("start") + size).alias("end"))


def kept_text(blocks: Column, skip: tuple[str, ...] = ("table_cell", "code", "reference")) -> Column:
    """Text of the blocks that are left in (two line breaks apart), and how many were left out, by reason: those of `skip`, and everything from an appendix on."""
    def chosen(b: Column) -> Column:
        appendix = scanned(F.transform(b, lambda x: F.when(x["text"].rlike(rf"(?i)^\s*(?:appendix|appendices){BOUNDARY}"), 1).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
        own = lambda x: x["text"].rlike(rf"(?i)^\s*(?:appendix|appendices){BOUNDARY}")
        order = [k for k in ("table_cell", "code") if k in skip]
        first = lambda x: F.when(x["kind"].isin(*order), x["kind"]) if order else F.lit(None).cast("string")
        reason = lambda x, at: F.coalesce(first(x), F.when((at == 1) | own(x), "appendix"), F.when((x["kind"] == "reference") & F.lit("reference" in skip), "reference"))
        told = F.zip_with(b, appendix, lambda x, at: F.struct(x["text"].alias("text"), reason(x, at).alias("reason")))
        left_out = lambda t, r: F.size(F.filter(t, lambda x: F.coalesce(x["reason"] == r, F.lit(False)))).cast("long").alias(f"skipped_{r}")
        joined = lambda t: F.array_join(F.transform(F.filter(t, lambda x: x["reason"].isNull()), lambda x: x["text"]), "\n\n").alias("text")
        return bound(told, lambda t: F.struct(joined(t), *(left_out(t, r) for r in ("table_cell", "code", "appendix", "reference"))))

    return bound(blocks, chosen)
