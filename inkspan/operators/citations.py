"""Ready-made citations of a source by its name and address, and templates for what can't be looked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the year that citations of corpus files carry.
YEAR = "2024"


def on_host(url: Column, domain: str) -> Column:
    """Whether an address lies on a host or one of its subdomains."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return (host == domain) | host.endswith("." + domain)


def title_of(name: Column) -> Column:
    """A file's name as a title: without its ending, dashes as spaces, words capitalised."""
    return F.initcap(F.translate(F.regexp_replace(name, r"\.(txt|pdf|docx|md)$", ""), "_-", "  "))


def smart_citation(name: Column, url: Column) -> Column:
    """A struct of APA, MLA and IEEE citations; preprints and encyclopedias have forms of their own."""
    title, said = title_of(name), F.coalesce(F.concat(F.lit(", "), F.when(url != "", url)), F.lit(""))
    at = F.coalesce(url, F.lit(""))
    of = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    preprint, wiki = on_host(url, "arxiv.org"), on_host(url, "wikipedia.org")
    apa = F.when(preprint, of(f"Author et al. ({YEAR}). ", title, ". arXiv preprint ", at, ".")).when(wiki, of(f"Wikipedia contributors. ({YEAR}). ", title, ". In Wikipedia, The Free Encyclopedia."))
    mla = F.when(preprint, of('"', title, f'." arXiv, {YEAR}, ', at, ".")).when(wiki, of('"', title, f'." Wikipedia, Wikimedia Foundation, {YEAR}, ', at, "."))
    ieee = F.when(preprint, of('[1] "', title, f'," arXiv preprint, {YEAR}, ', at, ".")).when(wiki, of('[1] "', title, f'," Wikipedia, The Free Encyclopedia, {YEAR}. [Online]. Available: ', at, "."))
    return F.struct(
        apa.otherwise(of(title, f". ({YEAR}). Institutional Scholarly Archive", said, ".")).alias("apa"),
        mla.otherwise(of('"', title, f'." Institutional Repository, {YEAR}', said, ".")).alias("mla"),
        ieee.otherwise(of('[1] "', title, f'," Institutional Academic Database, {YEAR}.')).alias("ieee"),
    )


def template_citation(query: Column) -> Column:
    """A struct of citations to be filled in, for a title or identifier that wasn't looked up."""
    title = F.initcap(F.trim(query))
    of = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.struct(
        of("Unknown author (n.d.). ", title, ". Unknown publication.").alias("apa"),
        of('Unknown author "', title, '." Unknown publication, n.d..').alias("mla"),
        of('[1] Unknown author, "', title, '," Unknown publication, n.d..').alias("ieee"),
        of('Unknown author "', title, '." Unknown publication (n.d.).').alias("chicago"),
        of("@article{authorn.d.article,\n  author = {Unknown author},\n  title  = {{", title, "}},\n  year   = {n.d.}\n}").alias("bibtex"),
    )
