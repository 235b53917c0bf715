"""Writing-pattern, style, citation, claim and audit signals.

The driver's documents hold few of these patterns, so the queries run over
`injected`: every document with a snippet of ours, picked by its id, behind it.
"""

from __future__ import annotations

import re

from inkspan.functions.text import MATCH_WORD, PATTERN_SENTENCE, PATTERN_WORD, PLAIN_WORD, careful_sentences, needed, trimmed
from inkspan.functions.udfs import text_scan
from inkspan.plans.overlap import overlap_by_source
from inkspan.plans.textstats import aliased, big, dbl, rhythm_score

SNIPPETS = (
    "Plain words end this page without any signal at all.",
    "Furthermore, we delve into a myriad of robust tools. It is worth noting that results may vary, and perhaps this may help.",
    "Studies show significant improvement in many cases. Research suggests that most people agree (Smith, 2020).",
    "In this paper, we will leverage a holistic approach. It is not just fast but also simple. In conclusion, the future looks bright.",
    "Certainly! Let me think step by step about the tapestry. I hope this helps.",
    "The plan — bold and new — failed. The problem: nobody read it. What matters: time.",
    "As Jones (2019) argues, and others [1, 2] and (Miller 23) repeat, 45% of users agree (Brown et al., 2021).\nReferences\nJones, A. (2019). A first book about tests.\n[1] Numbered entry about matching text.\nBrown, C. (2021). Another long entry here.\nJones, A. (2019). A first book about tests.\nUnused, Z. (1999). Nobody cites this entry.",
    "Contact ann@example.org at University of Somewhere. In our previous work we looked at a lot of things, https://github.com/ann/repo shows it.",
    "See doi: 10.1000/xyz123 and doi: 11.bad, http://localhost/x and https://example.com/a. ISBN 978-0-306-40615-7 or ISBN 978-0-306-40615-8.",
    "Turns out it works. That's the real point. This paper argues that more care than speed matters, using a dataset with significance. [TODO] utm_source=chatgpt.com",
    "Abstract\nThis study investigates an impact using an experiment. Basically we find out what everyone knows.\nMethodology\nWe make sure to get rid of things.\nConclusion\nIt has been shown to improve results.",
    "It is a pаssword with homоglyphs and zero​width signs, not just once, but twice over.",
    "---\n- **Label:** a vibrant and cutting-edge showcase.\n# Heading left in the text\nA **bold** claim, highlighting its importance.",
)

# Stock phrases, and patterns of the nine categories and of the other signals.
MARKERS = (
    "delve", "delve into", "tapestry", "testament to", "pivotal role", "seamless integration", "holistic approach", "multifaceted",
    "in the realm of", "the landscape of", "a myriad of", "a plethora of", "it is important to note", "it is worth noting",
    "plays a crucial role", "foster innovation", "game changer", "vibrant tapestry", "leverage", "utilize", "robust", "comprehensive", "streamline",
)
HEDGES = (
    r"\b(?:often|generally|typically|arguably|potentially|perhaps|possibly)\b", r"\bin many cases\b", r"\bit can be argued\b", r"\bone might consider\b",
    r"\bit is (?:important|worthwhile) to (?:note|mention)\b", r"\bresults may vary\b", r"\bmay (?:help|lead|result|suggest|indicate)\b",
)
TRANSITIONS = (
    r"(?m)^(?:furthermore|moreover|additionally),", r"\b(?:this highlights|this underscores|this demonstrates)\s+the\s+importance\s+of\b",
    r"\bas previously mentioned\b", r"\bin addition to the above\b", r"\bit goes without saying\b", r"\bneedless to say\b",
    r"\b(?:in conclusion|to summarize|in summary),?\b",
)
STRUCTURES = (
    r"\b(?:in this (?:paper|article|section),? (?:we|i) will|this (?:paper|article) (?:aims to|explores|examines))\b",
    r"\b(?:it(?:'s| is) not|not just)\b[^.!?]{2,100}\b(?:it(?:'s| is)|but)\b",
    r"\b(?:the key (?:insight|point|lesson) is|what (?:surprised|changed|worked|clicked)[^.!?]{0,40} was)\b",
    r"\b(?:the future looks bright|only time will tell|in conclusion|to summarize|in summary)\b",
    r"\b(?:is|are) (?:a testament to|pivotal to|crucial to)\b",
)
CHATBOT = (
    r"^\s*(?:certainly|absolutely|great question)[!,.]", r"\b(?:i hope this helps|let me know if you have any questions|feel free to reach out)\b",
    r"\b(?:let me think step by step|let'?s break this down|breaking this down)\b",
)
RHETORIC = (
    r"\bnot\s+(?:just\s+)?[^,.;]{2,70}(?:,|—|–)\s*(?:but\s+)?[^.!?]{2,90}",
    r"\b(?:turns out|what i (?:didn'?t expect|realized|found) was|the thing i realized was)\b",
    r"\bthat(?:'s| is) (?:the (?:real|actual|whole) (?:work|cost|point|thing)|what changed|what matters)\b",
    r"\bmore\s+[\w-]+\s+than\s+[\w-]+\b",
    r"\b(?:a testament to|pivotal role|vibrant tapestry)\b",
)
VAGUE = (
    r"\b(?:studies|research|experts|scholars|scientists)\s+(?:show|shows|suggest|suggests|indicate|indicates|found)\b",
    r"\b(?:many|most|numerous)\s+(?:organizations|people|researchers|students|companies|teams)\b",
    r"\b(?:significant|notable|substantial)\s+(?:improvement|progress|impact|effect|increase|decrease)s?\b",
    r"\bit (?:is|has been) (?:widely )?(?:known|accepted|established|shown)\b",
)
ANCHORED = r"\((?:[A-Z][\w'’–-]+(?:\s+(?:et\s+al\.|&\s*[A-Z][\w'’–-]+))?,\s*(?:19|20)\d{2}[a-z]?|(?:19|20)\d{2})[^)]*\)|\[\d+(?:\s*[-–,]\s*\d+)*\]"
ANCHOR = r"\b(?:19|20)\d{2}\b|\b\d+(?:\.\d+)?%\b|\b\d+(?:,\d{3})+(?:\.\d+)?\b|\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"
PROVENANCE = (
    r"\[(?:your name|insert (?:source|citation|name|date|link|here|[a-z]{3,20})|company name|client name|date here|placeholder|todo|tbd)\]|\b(?:19|20)\d{2}-xx-xx\b|\bxx[/-]xx[/-](?:19|20)\d{2}\b",
    r"\bciteturn\d+search\d+\b|\boai_citation\b|contentreference\[oaicite:\d+\](?:\{index=\d+\})?",
    r"utm_source=(?:chatgpt|copilot|perplexity|openai|claude|gemini|bard)(?:\.\w+)*",
)
CITATIONS = {
    "APA_PAREN": r"(?:\(|;\s*)([A-Z][\w'’–-]+(?:\s+(?:et\s+al\.|&\s*[A-Z][\w'’–-]+))?,\s*(?:19|20)\d{2}[a-z]?(?:,\s*p{1,2}\.?\s*\d+(?:[-–]\d+)?)?)\s*[;)]",
    "APA_NARRATIVE": r"\b([A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.|and\s+[A-Z][a-zA-Z]+))?)\s*\((?:19\d{2}|20\d{2})\)",
    "IEEE": r"\[(\d+(?:\s*[-–,]\s*\d+)*)\]",
    "MLA": r"\(([A-Z][a-zA-Z]+)\s+(?:\d{1,4})\)",
}
CLAIMS = (
    r"\b(?:studies|research|scholars|scientists|experts|investigators|literature)\s+(?:show|shows|prove|proves|suggest|suggests|state|states|found|demonstrate|demonstrates)\b",
    r"\b(?:it is (?:proven|established|known|evident|widely accepted|acknowledged))\b",
    r"\b(?:\d+%\s+of|\d+\s+percent\s+of)\b",
    r"\b(?:according to recent (?:findings|reports|data|surveys))\b",
    r"\b(?:has been shown to (?:cause|reduce|increase|improve|lead to))\b",
)
INFORMAL = {
    "a lot of": ("a substantial proportion of", "numerous", "an extensive quantity of"), "basically": ("fundamentally", "primarily", "essentially"),
    "get rid of": ("eliminate", "mitigate", "eradicate"), "big impact": ("significant effect", "substantial influence", "pronounced outcome"),
    "good results": ("statistically significant outcomes", "favorable empirical metrics", "robust performance"), "talk about": ("discuss", "examine", "articulate", "analyze"),
    "shows clearly": ("substantiates", "empirically illustrates", "demonstrates"), "really important": ("paramount", "critical", "pivotal", "of foundational importance"),
    "things": ("factors", "variables", "phenomena", "elements", "mechanisms"), "kind of": ("moderately", "partially", "to a certain degree"),
    "sort of": ("qualitatively similar to", "resembling"), "a bunch of": ("a cluster of", "an array of", "a multiplicity of"),
    "cannot be denied": ("evidence indicates", "literature demonstrates"), "everyone knows": ("it is widely recognized in scholarly consensus that",),
    "deal with": ("address", "manage", "intervene upon"), "find out": ("ascertain", "determine", "uncover"), "make sure": ("ensure", "verify", "ascertain"),
    "looked at": ("investigated", "evaluated", "scrutinized"),
}
ANONYMITY = (
    r"\b(?:in\s+our\s+previous\s+(?:work|paper|research|study))\b", r"\b(?:we\s+previously\s+(?:showed|demonstrated|introduced|published))\b",
    r"https?://(?:www\.)?github\.com/([a-zA-Z0-9_-]+)/([a-zA-Z0-9_-]+)", r"\b(?:our\s+laboratory|our\s+institution|our\s+group\s+at)\b",
    r"\b(?:grants?\s+(?:from|by|number)|supported\s+by\s+NSF|DARPA|NIH)\b",
)
FRONT_MATTER = (
    r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", r"\b(?:Department of|University of|School of|College of|Institute of)\b[^\n.!?]{0,120}",
    r"(?m)^[ \t]*(?:By\s+|Author:\s*)[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3}\s*$",
)
OPENING_HEAD = r"^[ \t]*(?:#+[ \t]*|\d+\.?[ \t]*)?{}[ \t]*(?::[ \t]*)?$"
OPENING_STOP = r"(?:keywords|introduction|background|related work|modeling approach|methods?|methodology|results(?: and comparison)?|discussion|conclusion|references)"
OPENING_PROSE = r"(?:this (?:paper|study|work)|we (?:hypothesi[sz]e|argue|propose|evaluate|investigate)|the central (?:claim|hypothesis|question)|model selection is)\b"
BOUND, PARAGRAPHS = r"\b", r"\n\s*\n"
THESIS = (
    (25, r"\b(hypothesi[sz](?:e|es)|argu(?:e|es)|propos(?:e|es)|demonstrat(?:e|es)|investigat(?:e|es)|examin(?:e|es)|aims? to|objective|central claim|research question)\b"),
    (20, r"\b(using|method|methodology|dataset|experiment|analyzed|evaluated|simulation|framework)\b"),
    (15, r"\b(crucial|significance|implication|contributes|advance|fundamental|impact)\b"),
)
#: Category and its label, in the order of the profile; least score of the two upper bands; words from which a profile is reliable.
LABELS = {
    "predictability": "Predictable vocabulary", "burstiness": "Sentence rhythm", "hedging": "Hedge density", "structure": "Formulaic structure",
    "specificity": "Specificity and grounding", "transitions": "Transition fingerprint", "punctuation": "Punctuation fingerprint",
    "register": "Assistant-style register", "rhetoric": "Rhetorical scaffolding",
}
ELEVATED, HIGH, RELIABLE_WORDS = 25, 65, 120
HIDDEN = "​‌‍﻿­⁠‎‏‪‫‬‭‮"
LOOKALIKES = "аеорсухіјѕвнтАВЕКМНОРСТХУαεορνΑΒΕΗΙΚΜΝΟΡΤΧΥΖａｂｃｄｅ"
LATIN = "aeopcyxijsbhtABEKMHOPCTXYaeopvABEHIKMNOPTXYZabcde"


def _source(d) -> str:
    """doc_id and text: each document with the snippet of its number modulo their count."""
    if d.plain:
        return "SELECT doc_id, text FROM documents"

    def literal(s: str) -> str:
        pieces = [p.replace("\\", "\\\\") if d.name == "spark" else p for p in s.split("\n")]
        quote = (lambda p: "'" + p.replace("'", "\\'") + "'") if d.name == "spark" else (lambda p: "'" + p.replace("'", "''") + "'")
        return f" || {d.char(10)} || ".join(quote(p) for p in pieces)

    cases = " ".join(f"WHEN {k} THEN {literal(s)}" for k, s in enumerate(SNIPPETS))
    return f"SELECT doc_id, text || {d.char(10)} || CASE doc_id % {len(SNIPPETS)} {cases} END AS text FROM documents"


def _rows(d) -> str:
    """The same as a table expression."""
    return f"({_source(d)})" + (" t" if d.name == "spark" else "")


def ci(regex: str) -> str:
    return "(?i)" + regex


def total(d, patterns, text: str = "text") -> str:
    return "(" + " + ".join(d.count(text, ci(p)) for p in patterns) + ")"


def band(n: str, moderate: int, strong: int) -> str:
    return f"CASE WHEN {n} <= 0 THEN 0 WHEN {n} >= {strong} THEN 3 WHEN {n} >= {moderate} THEN 2 ELSE 1 END"


def _evidence_columns(d, words: str = "") -> str:
    """Hits of each category, with words (where they are known, as `words`) and bullets, from columns text and seen."""
    markers = " + ".join(f"CASE WHEN {d.like('seen', ci(chr(92) + 'b' + m + chr(92) + 'b'))} THEN 1 ELSE 0 END" for m in MARKERS)
    bullets = d.count("text", r"(?m)^[ \t]*(?:[-*•]|\d+[.)])\s+")
    each_marker = " + ".join(d.count("seen", ci(rf"\b{m}\b")) for m in MARKERS)
    return f"""{big(words or d.count(d.lows.get("text") or "lower(text)", PATTERN_WORD))} AS words, {big(markers)} AS distinct_markers, {big(each_marker)} AS markers, {big(total(d, HEDGES, "seen"))} AS hedges,
  {big(total(d, STRUCTURES, "seen") + f" + CASE WHEN {bullets} >= 5 THEN 1 ELSE 0 END")} AS structures, {big(total(d, TRANSITIONS, "seen"))} AS transitions,
  {big(d.count("text", "—"))} AS em_dashes, {big(d.spaced_dashes("text"))} AS double_dashes, {big(d.count("text", r"—[^—\n]{2,100}—"))} AS wrapped,
  {big(d.count("seen", ci(r"\b(?:the (?:problem|answer|reason|rule|point)|what matters)\s*:")))} AS colons, {big(total(d, CHATBOT, "seen"))} AS chatbot,
  {big(total(d, RHETORIC, "seen"))} AS rhetoric, {big(total(d, PROVENANCE, "seen"))} AS provenance"""


def pattern_evidence(d) -> str:
    """Hits of each category, with words and bullets."""
    if d.name == "spark":
        return f"SELECT doc_id, {_evidence_columns(d.lowered({'text': 'low', 'seen': 'low'}))} FROM (SELECT doc_id, text, text AS seen, lower(text) AS low FROM ({_source(d)}) t) t"
    return f"SELECT doc_id, {_evidence_columns(d)} FROM (SELECT doc_id, text, {d.seen('text')} AS seen FROM ({_source(d)}) t) t"


def _in_row(d, evidence: bool = True) -> str:
    """Evidence, rhythm and specificity of each text in its own row, by arrays of its sentences: Spark's form of the joins of `pattern_scores`."""
    sought: list[tuple[str, ...]] = []
    d = d.lowered({"text": "low", "seen": "low", "s.x": "s.low"}).searched(sought)
    strings = lambda patterns: sorted({n for p in patterns for n in needed(ci(p))})
    unmarked = lambda x: f"NOT ({d.like(x, ANCHORED)}) AND NOT ({d.like(x, ANCHOR)})"
    vague, claim, cited = (" OR ".join(d.like("s.x", p) for p in patterns) for patterns in (map(ci, VAGUE), map(ci, CLAIMS), CITATIONS.values()))
    both = lambda array: f"transform({array}, x -> struct(x AS x, lower(x) AS low))"
    # Of a text's sentences only those come that hold a string which every vague claim needs; a text without one that every claim needs isn't cut into sentences for them.
    loose = f"transform(filter({both('found.vague')}, s -> ({vague}) AND length({trimmed(d, 's.x')}) >= 4 AND {unmarked('s.x')}), s -> substring({trimmed(d, 's.x')}, 1, 220))"
    claims_ = f"""CASE WHEN NOT ({d.holds("text", strings(CLAIMS))}) THEN {EMPTY}
      ELSE transform(filter({both(careful_sentences(d))}, s -> ({claim}) AND length({trimmed(d, "s.x")}) > 20 AND NOT ({cited})), s -> {trimmed(d, "s.x")}) END"""
    bare = f"CASE WHEN size(found.long) = 0 THEN 0 ELSE size(filter({d.split('text', PARAGRAPHS)}, (x, i) -> array_contains(found.long, i) AND {unmarked('x')})) END"
    mean = "aggregate(lengths, 0D, (s, x) -> s + x) / greatest(1, size(lengths))"
    varies = f"sqrt(aggregate(lengths, 0D, (s, x) -> s + (x - mean) * (x - mean)) / size(lengths)) / mean * 100"
    three = "get(lengths, i), get(lengths, i + 1), get(lengths, i + 2)"
    runs = f"size(filter(sequence(0, greatest(size(lengths) - 3, 0)), i -> greatest({three}) - least({three}) <= 5 AND least({three}) >= 8))"
    own = f"{_evidence_columns(d, 'found.words')}, " if evidence else "found.words AS words, "
    scan = text_scan(sought, strings(VAGUE), 35, RELIABLE_WORDS)
    return f"""SELECT *, {big("CASE WHEN sentences < 5 THEN 0 WHEN burstiness < 18 OR uniform_runs >= 3 THEN 3 WHEN burstiness < 27 OR uniform_runs >= 2 THEN 2 WHEN burstiness < 35 OR uniform_runs = 1 THEN 1 ELSE 0 END")} AS score FROM (
  SELECT *, {big("size(lengths)")} AS sentences, CASE WHEN size(lengths) < 2 THEN 50D WHEN mean = 0 THEN 0D ELSE {d.round(f"least(100D, {varies})", 2)} END AS burstiness,
    {big(f"CASE WHEN size(lengths) < 3 THEN 0 ELSE {runs} END")} AS uniform_runs, {big("size(loose)")} AS unanchored,
    {big("size(array_except(filter(open_claims, x -> length(x) <= 220), loose)) + size(filter(open_claims, x -> length(x) > 220))")} AS unsupported FROM (
    SELECT *, {mean} AS mean FROM (
      SELECT doc_id, {own}found.lengths AS lengths, {loose} AS loose, {claims_} AS open_claims, {big(f"CASE WHEN found.words >= {RELIABLE_WORDS} THEN {bare} ELSE 0 END")} AS bare_paragraphs FROM (
        SELECT *, {scan}(text, low) AS found FROM (SELECT doc_id, text, text AS seen, lower(text) AS low FROM ({_source(d)}) t) t) t) t) t) t"""


def specificity(d) -> str:
    """Sentences that claim vaguely with neither a citation nor an anchor, other claims without a citation, and long paragraphs with neither.

    A claim counts if its sentence isn't among the vague ones, once for each
    wording of up to 220 characters. Paragraphs count from 120 words of text on.
    """
    if d.name == "spark":
        return f"SELECT doc_id, unanchored, unsupported, bare_paragraphs FROM ({_in_row(d, False)}) t"
    found = d.each(_rows(d), d.all("text", PATTERN_SENTENCE), "s", "piece")
    vague = " OR ".join(d.like("piece", ci(p)) for p in VAGUE)
    paragraphs = d.each(_rows(d), d.split("text", r"\n\s*\n"), "s", "piece")
    unmarked = f"NOT ({d.like('piece', ANCHORED)}) AND NOT ({d.like('piece', ANCHOR)})"
    return f"""WITH u AS (SELECT doc_id, substring({trimmed(d, "piece")}, 1, 220) AS sentence FROM {found} WHERE length({trimmed(d, "piece")}) >= 4 AND ({vague}) AND {unmarked}),
c AS (SELECT doc_id, sentence, CASE WHEN length(sentence) <= 220 THEN 1 ELSE count(*) END AS n FROM ({_claims(d, "sentence")}) x WHERE NOT has_citation GROUP BY doc_id, sentence),
k AS (SELECT c.doc_id, sum(c.n) AS n FROM c LEFT JOIN (SELECT DISTINCT doc_id, sentence FROM u) v ON c.doc_id = v.doc_id AND c.sentence = v.sentence WHERE v.doc_id IS NULL GROUP BY c.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n FROM {paragraphs} WHERE {d.count("lower(piece)", PATTERN_WORD)} >= 35 AND {unmarked} GROUP BY doc_id)
SELECT t.doc_id, {big("coalesce(n.n, 0)")} AS unanchored, {big("coalesce(k.n, 0)")} AS unsupported,
  {big(f"CASE WHEN {d.count('lower(t.text)', PATTERN_WORD)} >= {RELIABLE_WORDS} THEN coalesce(p.n, 0) ELSE 0 END")} AS bare_paragraphs
FROM {aliased(_rows(d))} LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN k ON t.doc_id = k.doc_id LEFT JOIN p ON t.doc_id = p.doc_id"""


def pattern_scores(d, *more: str) -> str:
    """Scores 0 to 3 of nine categories, their total of 27 in percent, its band, and the number of evidence rows of each category.

    A text without words or sentences is insufficient: no points. `more`: columns
    of the texts' rows that are kept, in Spark's form.
    """
    dash = f"""CASE WHEN e.em_dashes = 0 AND e.double_dashes = 0 AND e.colons = 0 THEN 0
    WHEN e.wrapped > 0 OR {dbl("e.em_dashes")} / greatest(1, e.words) * 300 > 3 OR e.colons >= 2 THEN 2 ELSE 1 END"""
    hedge = f"CASE WHEN {dbl('e.hedges')} / greatest(1, e.words) * 100 >= 3 THEN 3 WHEN {dbl('e.hedges')} / greatest(1, e.words) * 100 >= 1.5 THEN 2 WHEN e.hedges > 0 THEN 1 ELSE 0 END"
    cols = {
        "predictability": band("e.distinct_markers", 2, 5),
        "burstiness": "r.score",
        "hedging": hedge,
        "structure": band("e.structures", 2, 4),
        "specificity": band("(s.unanchored + s.unsupported + s.bare_paragraphs)", 2, 4),
        "transitions": band("e.transitions", 2, 4),
        "punctuation": dash,
        "register": "CASE WHEN e.chatbot >= 2 THEN 3 WHEN e.chatbot > 0 THEN 2 ELSE 0 END",
        "rhetoric": band("e.rhetoric", 2, 4),
    }
    rows = {
        "predictability": "e.markers", "burstiness": "r.uniform_runs", "hedging": "e.hedges", "structure": "e.structures", "specificity": "s.unanchored + s.unsupported",
        "transitions": "e.transitions", "punctuation": "e.em_dashes + e.double_dashes + least(1, e.wrapped) + e.colons", "register": "e.chatbot", "rhetoric": "e.rhetoric",
    }
    enough = "e.words > 0 AND r.sentences > 0"
    listed = ", ".join(f"{big(f'CASE WHEN {enough} THEN {v} ELSE 0 END')} AS {k}" for k, v in cols.items())
    counted = ", ".join(f"{big(f'CASE WHEN {enough} THEN {v} ELSE 0 END')} AS n_{k}" for k, v in rows.items())
    joined = f"({pattern_evidence(d)}) e JOIN ({rhythm_score(d, _rows(d))}) r ON e.doc_id = r.doc_id JOIN ({specificity(d)}) s ON e.doc_id = s.doc_id"
    if d.name == "spark":  # one row has all
        enough, listed, counted = (re.sub(r"\b[rs]\.", "e.", x) for x in (enough, listed, counted))
        joined = f"({_in_row(d)}) e"
    return f"""WITH c AS (
  SELECT e.doc_id, e.words, CASE WHEN {enough} THEN e.provenance ELSE 0 END AS provenance, {enough} AS enough, {listed}, {counted}{"".join(f", {x}" for x in more)}
  FROM {joined}
), t AS (SELECT *, {" + ".join(cols)} AS points FROM c)
SELECT *, {d.round(f'{dbl("points")} / 27 * 100', 1)} AS pattern_score,
  CASE WHEN NOT enough THEN 'Insufficient Text' WHEN {d.round(f'{dbl("points")} / 27 * 100', 1)} < {ELEVATED} THEN 'Low Pattern Score'
    WHEN {d.round(f'{dbl("points")} / 27 * 100', 1)} < {HIGH} THEN 'Elevated Pattern Score' ELSE 'High Pattern Score' END AS pattern_band,
  CASE WHEN NOT enough THEN 'insufficient' WHEN words < {RELIABLE_WORDS} THEN 'limited' ELSE 'standard' END AS reliability FROM t"""


def top_signals(d) -> str:
    """The up to four categories of most points of each document; ties by number of evidence rows, then by label."""
    names = tuple(LABELS)
    quoted, rows = d.array(f"'{n}'" for n in names), d.each("u", "names", "k", "category")
    labels = d.array(f"'{n}'" for n in LABELS.values())
    return f"""WITH s AS ({pattern_scores(d)}),
u AS (SELECT doc_id, {quoted} AS names, {labels} AS titles, {d.array(names)} AS scores, {d.array(f"n_{n}" for n in names)} AS counts FROM s),
v AS (SELECT doc_id, category, {d.at("titles", "k")} AS label, {d.at("scores", "k")} AS score, {d.at("counts", "k")} AS evidence_count FROM {rows})
SELECT doc_id, category, label, score, evidence_count, {big("place")} AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, evidence_count DESC, label) AS place FROM v WHERE score > 0) r WHERE place <= 4"""


def calibration(d) -> str:
    """Distribution of the pattern score over all documents: quantiles by rank, documents flagged, documents in which each category fires.

    Scores take 28 values at most, so ranks are read off their counts.
    """
    fired = ", ".join(f"sum(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) AS {c}" for c in LABELS)
    rank = lambda p: f"max(CASE WHEN high > {p} AND high - n <= {p} THEN pattern_score END)"  # noqa: E731  the score of rank p, from 0
    place = lambda pct: f"floor({dbl(pct)} / 100 * (total - 1) + 0.5)"
    totals = ", ".join(f"{big(f'sum({c})')} AS fired_{c}" for c in LABELS)
    return f"""WITH h AS (SELECT pattern_score, count(*) AS n, {fired} FROM ({pattern_scores(d)}) p GROUP BY pattern_score),
r AS (SELECT *, sum(n) OVER (ORDER BY pattern_score) AS high, sum(n) OVER () AS total FROM h)
SELECT {big("max(total)")} AS documents, {d.round(f'{dbl("sum(n * pattern_score)")} / max(total)', 2)} AS mean,
  ({rank("floor((total - 1) / 2.0)")} + {rank("ceil((total - 1) / 2.0)")}) / 2 AS median,
  {d.round(f'sqrt(greatest({dbl("0")}, {dbl("sum(n * pattern_score * pattern_score)")} / max(total) - ({dbl("sum(n * pattern_score)")} / max(total)) * ({dbl("sum(n * pattern_score)")} / max(total))))', 2)} AS deviation,
  max(pattern_score) AS largest, {rank(place(75))} AS p75, {rank(place(90))} AS p90, {rank(place(95))} AS p95, {rank("total - 1")} AS p100,
  {big(f"sum(CASE WHEN pattern_score >= {ELEVATED} THEN n ELSE 0 END)")} AS elevated, {big(f"sum(CASE WHEN pattern_score >= {HIGH} THEN n ELSE 0 END)")} AS high, {totals} FROM r"""


def sanitized(d) -> str:
    """Text without hidden characters and with Latin letters for lookalikes, and how many of either there were."""
    count = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    return f"""SELECT doc_id, translate(text, '{LOOKALIKES + HIDDEN}', '{LATIN}') AS cleaned, {big(count(LOOKALIKES))} AS homoglyphs, {big(count(HIDDEN))} AS zero_width,
  ({count(LOOKALIKES)}) + ({count(HIDDEN)}) > 0 AS has_obfuscation FROM ({_source(d)}) t"""


def mixed_script_words(d) -> str:
    words = d.each(f"({_source(d)})" + (" t" if d.name == "spark" else ""), d.all("text", MATCH_WORD), "i", "word")
    latin, other = (r"\p{IsLatin}", r"[\p{IsGreek}\p{IsCyrillic}]") if d.name == "spark" else (r"\p{Latin}", r"[\p{Greek}\p{Cyrillic}]")
    return f"SELECT doc_id, {big('i')} AS word_no, word FROM {words} WHERE {d.like('word', latin)} AND {d.like('word', other)}"


#: An empty array of strings in Spark's dialect.
EMPTY = "slice(array(''), 1, 0)"
HEADER = r"(?im)^[ \t]*(?:#+|\d+\.|\*+)?[ \t]*(?:references|works[ ]+cited|bibliography|literature[ ]+cited|reference[ ]+list)[ \t]*[:#*]*[ \t]*$"


def _parts(d) -> str:
    """Body and bibliography: before, and from, the first header line."""
    marked = d.replace("text", HEADER, "\x03")
    if d.name == "spark":  # a text without a header line isn't rewritten
        return f"""SELECT doc_id, text, low, body, CASE WHEN headed THEN substring(marked, length(body) + 2) ELSE '' END AS bib FROM (
  SELECT *, coalesce(substring_index(marked, {d.char(3)}, 1), '') AS body FROM (
    SELECT *, CASE WHEN headed THEN {marked} ELSE text END AS marked FROM (
      SELECT *, {d.lowered({"text": "low"}).like("text", HEADER)} AS headed FROM (SELECT doc_id, text, lower(text) AS low FROM ({_source(d)}) t) t) t) t) t"""
    return f"""SELECT doc_id, text, {d.at(d.split(marked, chr(92) + 'x03'), "0")} AS body,
  CASE WHEN {d.like("text", HEADER)} THEN substring({marked}, length({d.at(d.split(marked, chr(92) + 'x03'), "0")}) + 2) ELSE '' END AS bib FROM ({_source(d)}) t"""


SURNAME, YEAR, NUMBER = r"[A-Z][\w’'-]+", r"(?:19|20)\d{2}[a-z]?", r"^\[?([0-9]+)[\].]"
ENTRY = r"^(?:\[\d+\]|\d+\.|\*|[A-Z][a-zA-Z]+,)"


def _lined(d) -> str:
    """The rows of `parts` with the lines of their bibliography and the places where an entry begins."""
    begins = f"filter(sequence(0, size(lines) - 1), i -> i = 0 OR get(lines, i) = '' OR {d.like('get(lines, i)', ENTRY)})"
    return f"SELECT *, {begins} AS begins FROM (SELECT *, transform({d.split('bib', chr(92) + 'n')}, x -> {trimmed(d, 'x')}) AS lines FROM parts) t"


def _entry_array(d) -> str:
    """Entries from columns lines and begins: Spark's form of `_entries`.

    It stands in the explosion itself: of a named array Catalyst asks for its size
    first, and works out all that the name stands for once more for that.
    """
    entry = f"array_join(filter(slice(lines, i + 1, coalesce(get(begins, k + 1), size(lines)) - i), x -> x <> '' AND x <> {d.char(3)}), ' ')"
    return f"filter(transform(begins, (i, k) -> {entry}), x -> length(x) > 15)"


def _entries(d) -> str:
    """Bibliography entries of more than 15 characters in order; a blank line or a line that looks like a start begins one."""
    if d.name == "spark":
        return f"entries AS (SELECT doc_id, e + 1 AS e, entry FROM {d.each(f'({_lined(d)}) t', _entry_array(d), 'e', 'entry')})"
    lines = d.each("parts", d.split("bib", r"\n"), "l", "line")
    return f"""lines AS (SELECT doc_id, l, {trimmed(d, "line")} AS line FROM {lines}),
marked AS (
  SELECT doc_id, l, line, sum(CASE WHEN line = '' OR {d.like("line", ENTRY)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY l) AS g FROM lines
),
entries AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS e, entry FROM (
    SELECT doc_id, g, {d.joined("line", "l", " ")} AS entry FROM marked WHERE line <> '' AND line <> {d.char(3)} GROUP BY doc_id, g) j WHERE length(entry) > 15
)"""


#: Signs one of which every citation of a style holds.
OPENED = {"APA_PAREN": ["(", ";"], "APA_NARRATIVE": ["("], "IEEE": ["["], "MLA": ["("]}


def _cited(d) -> str:
    """The rows of `parts` with arrays of their citations (style, c, content, surname, year, numbers, linked) and entries (e, entry, line, number).

    Spark's form of the joins of `_links`: a text is read once, and neither it nor
    its citations leave the row.
    """
    low = d.lowered({"body": "low"})
    opened = lambda style, p: f"CASE WHEN {low.holds('body', OPENED[style])} THEN {d.all('body', p, 1)} ELSE {EMPTY} END"
    found = ", ".join(f"transform({opened(style, p)}, (x, c) -> struct('{style}' AS style, c AS c, x AS content))" for style, p in CITATIONS.items())
    named = lambda value, other: f"CASE WHEN s.style <> 'IEEE' THEN {value} ELSE {other} END"
    surname = trimmed(d, d.replace(f"lower({d.first('s.content', SURNAME)})", r"[^a-z0-9_]+", " "))
    said = f"""transform(said, s -> struct(s.style AS style, s.c AS c, s.content AS content, {named(surname, "''")} AS surname, {named(d.first("s.content", YEAR), "''")} AS year,
      {named(EMPTY, f"array_distinct({d.all('s.content', '[0-9]+')})")} AS numbers))"""
    worded = f"""transform(entries, (x, k) -> struct(k + 1 AS e, x AS entry, ' ' || {d.replace("lower(x)", r"[^a-z0-9_]+", " ")} || ' ' AS line, {d.first("x", NUMBER, 1)} AS number))"""
    linked = named("s.surname <> '' AND exists(worded, w -> contains(w.line, ' ' || s.surname || ' ') AND (s.year = '' OR contains(w.entry, s.year)))", "size(array_except(s.numbers, worded.number)) = 0")
    kept = ", ".join(f"s.{k} AS {k}" for k in ("style", "c", "content", "surname", "year", "numbers"))
    return f"""SELECT doc_id, text, low, transform(said, s -> struct({kept}, {linked} AS linked)) AS cites, worded AS entries FROM (
  SELECT doc_id, text, low, {said} AS said, {worded} AS worded FROM (SELECT *, concat({found}) AS said, {_entry_array(d)} AS entries FROM ({_lined(d)}) t) t) t"""


def _cites(d) -> str:
    rows = []
    for style, pattern in CITATIONS.items():
        found = d.each("parts", d.all("body", pattern, 1), "c", "content")
        rows.append(f"SELECT doc_id, '{style}' AS style, c, content FROM {found}")
    return "cites AS (" + " UNION ALL ".join(rows) + ")"


def citation_scan(d) -> str:
    """In-text citations of each style in the body, numbered, with what they say and where that begins."""
    if d.name == "spark":
        low = d.lowered({"body": "low"})
        opened = lambda style, found: f"CASE WHEN {low.holds('body', OPENED[style])} THEN {found} ELSE {EMPTY} END"
        columns = ", ".join(f"{opened(k, d.all('body', p))} AS {k}_raw, {opened(k, d.all('body', p, 1))} AS {k}_said, {opened(k, d.split('body', p))} AS {k}_pieces" for k, p in CITATIONS.items())
        each = ", ".join(f"transform({k}_raw, (x, c) -> struct('{k}' AS style, c AS c, x AS raw, get({k}_said, c) AS content, length(get({k}_pieces, c)) AS lead, length(x) AS own))" for k in CITATIONS)
        rows = f"(SELECT doc_id, {columns} FROM ({_parts(d)}) t) t LATERAL VIEW explode(concat({each})) AS m"
        return f"""SELECT doc_id, style, {big("c")} AS citation_no, raw, content, {big("sum(lead + own) OVER (PARTITION BY doc_id, style ORDER BY c) - own")} AS start_offset FROM (SELECT doc_id, m.* FROM {rows}) t"""
    rows = []
    for style, pattern in CITATIONS.items():
        # A match begins behind the pieces and matches before it, its content at the first place of the content in it.
        pieces, found = d.split("body", pattern), d.all("body", pattern)
        each = d.each("(SELECT doc_id, body, " + f"{found} AS found, {d.all('body', pattern, 1)} AS said, {pieces} AS pieces FROM parts) x", "found", "c", "raw")
        rows.append(f"""SELECT doc_id, '{style}' AS style, c, raw, {d.at("said", "c")} AS content, length({d.at("pieces", "c")}) AS lead, length(raw) AS own FROM {each}""")
    return f"""WITH parts AS ({_parts(d)}), found AS ({" UNION ALL ".join(rows)})
SELECT doc_id, style, {big("c")} AS citation_no, raw, content, {big("sum(lead + own) OVER (PARTITION BY doc_id, style ORDER BY c) - own")} AS start_offset FROM found"""


def bibliography_entries(d) -> str:
    return f"WITH parts AS ({_parts(d)}), {_entries(d)} SELECT doc_id, {big('e')} AS entry_no, entry FROM entries"


def _links(d) -> str:
    """Citations and the entries they mean: by surname as a word and year; numbered ones only if each number has an entry."""
    surname = d.first("c.content", SURNAME)
    year = d.first("c.content", YEAR)
    numbers = d.each("ieee", "ns", "k", "number")
    return f"""named AS (SELECT doc_id, style, c, {trimmed(d, d.replace(f"lower({surname})", r"[^a-z0-9_]+", " "))} AS surname, {year} AS year FROM cites c WHERE style <> 'IEEE'),
worded AS (SELECT doc_id, e, entry, ' ' || {d.replace("lower(entry)", r"[^a-z0-9_]+", " ")} || ' ' AS line FROM entries),
ieee AS (SELECT doc_id, c, {d.all("content", r"[0-9]+")} AS ns FROM cites WHERE style = 'IEEE'),
numbers AS (SELECT DISTINCT doc_id, c, number FROM {numbers}),
marks AS (SELECT doc_id, e, {d.first("entry", NUMBER, 1)} AS number FROM entries),
pairs AS (SELECT n.doc_id, n.c, n.number, m.e FROM numbers n LEFT JOIN marks m ON n.doc_id = m.doc_id AND n.number = m.number),
whole AS (SELECT doc_id, c FROM pairs GROUP BY doc_id, c HAVING sum(CASE WHEN e IS NULL THEN 1 ELSE 0 END) = 0),
links AS (
  SELECT n.doc_id, n.style, n.c, e.e FROM named n JOIN worded e ON n.doc_id = e.doc_id
  WHERE n.surname <> '' AND contains(e.line, ' ' || n.surname || ' ') AND (n.year = '' OR contains(e.entry, n.year))
  UNION ALL SELECT p.doc_id, 'IEEE' AS style, p.c, p.e FROM pairs p JOIN whole w ON p.doc_id = w.doc_id AND p.c = w.c
)"""


def citation_links(d) -> str:
    """Citations, those linked to an entry by surname and year or by all their numbers, and the bibliography's size."""
    if d.name == "spark":
        return f"""WITH parts AS ({_parts(d)}) SELECT doc_id, {big("size(cites)")} AS citations, {big("size(filter(cites, s -> s.linked))")} AS linked,
  {big("size(filter(cites, s -> NOT s.linked))")} AS unlinked, {big("size(entries)")} AS entries FROM ({_cited(d)}) t"""
    return f"""WITH parts AS ({_parts(d)}), {_cites(d)}, {_entries(d)}, {_links(d)},
per AS (SELECT doc_id, count(*) AS n FROM cites GROUP BY doc_id), good AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, style, c FROM links) x GROUP BY doc_id),
size AS (SELECT doc_id, count(*) AS n FROM entries GROUP BY doc_id)
SELECT p.doc_id, {big("coalesce(per.n, 0)")} AS citations, {big("coalesce(good.n, 0)")} AS linked, {big("coalesce(per.n, 0) - coalesce(good.n, 0)")} AS unlinked,
  {big("coalesce(size.n, 0)")} AS entries FROM parts p LEFT JOIN per ON p.doc_id = per.doc_id LEFT JOIN good ON p.doc_id = good.doc_id LEFT JOIN size ON p.doc_id = size.doc_id"""


def uncited_references(d) -> str:
    """Entries that no linked citation names, by surname alone or by any of its numbers."""
    if d.name == "spark":
        meant = "s.linked AND CASE WHEN s.style = 'IEEE' THEN array_contains(s.numbers, w.number) ELSE contains(w.line, ' ' || s.surname || ' ') END"
        rows = f"({_cited(d)}) t LATERAL VIEW explode(filter(entries, w -> NOT exists(cites, s -> {meant}))) AS w"
        return f"WITH parts AS ({_parts(d)}) SELECT doc_id, {big('w.e')} AS entry_no, w.entry AS entry FROM {rows}"
    return f"""WITH parts AS ({_parts(d)}), {_cites(d)}, {_entries(d)}, {_links(d)}, good AS (SELECT DISTINCT doc_id, style, c FROM links),
cited AS (
  SELECT n.doc_id, e.e FROM named n JOIN good g ON n.doc_id = g.doc_id AND n.style = g.style AND n.c = g.c JOIN worded e ON n.doc_id = e.doc_id WHERE contains(e.line, ' ' || n.surname || ' ')
  UNION SELECT doc_id, e FROM links WHERE style = 'IEEE'
)
SELECT e.doc_id, {big("e.e")} AS entry_no, e.entry FROM entries e LEFT JOIN cited l ON e.doc_id = l.doc_id AND e.e = l.e WHERE l.e IS NULL"""


def citations_without_reference(d) -> str:
    if d.name == "spark":
        rows = f"({_cited(d)}) t LATERAL VIEW explode(filter(cites, s -> NOT s.linked)) AS s"
        return f"WITH parts AS ({_parts(d)}) SELECT doc_id, s.style AS style, {big('s.c')} AS citation_no, s.content AS content FROM {rows}"
    return f"""WITH parts AS ({_parts(d)}), {_cites(d)}, {_entries(d)}, {_links(d)}
SELECT c.doc_id, c.style, {big("c.c")} AS citation_no, c.content FROM cites c LEFT JOIN (SELECT DISTINCT doc_id, style, c FROM links) l
  ON c.doc_id = l.doc_id AND c.style = l.style AND c.c = l.c WHERE l.c IS NULL"""


def duplicate_references(d) -> str:
    normal = trimmed(d, d.replace("lower(entry)", r"[^\p{L}\p{N}_]+", " "))
    return f"""WITH parts AS ({_parts(d)}), {_entries(d)}
SELECT doc_id, {big("e")} AS entry_no, {big("first_e")} AS duplicates FROM (SELECT doc_id, e, min(e) OVER (PARTITION BY doc_id, {normal}) AS first_e FROM entries) r WHERE e > first_e"""


def alphabetized_references(d) -> str:
    """Entries without their numbering, ordered by author, and whether a year and a link are there."""
    clean = d.replace("entry", r"^(\[\d+\]|\d+[\.\)]\s*)", "")
    author = d.first("cleaned", r"^([A-Z][a-zA-Z\-'`]+)", 1)
    return f"""WITH parts AS ({_parts(d)}), {_entries(d)}, c AS (SELECT doc_id, e, {trimmed(d, clean)} AS cleaned FROM entries)
SELECT doc_id, cleaned, {big(f"row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {author} <> '' THEN lower({author}) ELSE lower(cleaned) END, e)")} AS place,
  {d.like("cleaned", r"\b(19\d\d|20\d\d)\b")} AS has_year, {d.like("cleaned", r"(10\.\d{4,9}/|doi\.org|http)")} AS has_link FROM c"""


def link_checks(d) -> str:
    """URLs with no public host and DOIs that don't parse."""
    source = f"({_source(d)})" + (" t" if d.name == "spark" else "")
    urls = d.each(source, d.all("text", r"(?i)\bhttps?://[^\s<>\]\[\"']+"), "n", "value")
    dois = d.each(source, d.all("text", r"(?i)\bdoi\s*:\s*([^\s,;]+)", 1), "n", "value")
    cut = d.replace("value", r"[.,);]+$", "")
    host = d.first(cut, r"^(?i:https?)://([^/?#:]*)", 1)
    return f"""SELECT doc_id, 'malformed_or_private_url' AS code, {cut} AS value FROM {urls} WHERE {host} = '' OR {host} = 'localhost' OR {d.like(host, r"\.(local|internal)$")}
UNION ALL SELECT doc_id, 'invalid_doi_syntax' AS code, {cut} AS value FROM {dois} WHERE NOT ({d.like(cut, r"(?i)^10\.\d{4,9}/[-._;()/:A-Z0-9]+$")})"""


def isbn_checks(d) -> str:
    """ISBN candidates and whether their check digit holds."""
    found = d.each(f"({_source(d)})" + (" t" if d.name == "spark" else ""), d.all("text", r"ISBN\s*:?\s*([0-9][0-9Xx\s-]{8,16}[0-9Xx])", 1), "n", "value")
    digit = lambda k: f"CAST(CASE WHEN upper(substring(x, {k}, 1)) = 'X' THEN '10' ELSE substring(x, {k}, 1) END AS INT)"
    ten = " + ".join(f"{11 - k} * {digit(k)}" for k in range(1, 11))
    thirteen = " + ".join(f"{1 if k % 2 else 3} * {digit(k)}" for k in range(1, 13))
    return f"""SELECT doc_id, value, CASE WHEN length(x) = 10 THEN ({ten}) % 11 = 0
  WHEN length(x) = 13 AND NOT ({d.like("x", "[Xx]")}) THEN (10 - ({thirteen}) % 10) % 10 = {digit(13)} ELSE false END AS valid
FROM (SELECT doc_id, value, {d.replace("value", "[^0-9Xx]", "")} AS x FROM {found}) v"""


def _claim_array(d) -> str:
    """Claims of more than 20 characters (s, x, low), from columns text and low: Spark's form of `_claims`. Only a text that holds a claim's words is cut into sentences."""
    d = d.lowered({"text": "low", "s.x": "s.low"})
    claim = lambda x: " OR ".join(d.like(x, ci(p)) for p in CLAIMS)
    sentences = f"transform(CASE WHEN {claim('text')} THEN {careful_sentences(d)} ELSE {EMPTY} END, (x, i) -> struct(i AS s, x AS x, lower(x) AS low))"
    return f"filter({sentences}, s -> ({claim('s.x')}) AND length({trimmed(d, 's.x')}) > 20)"


def _claims(d, *more: str) -> str:
    """Claims of more than 20 characters; `more`: "sentence" for their text too."""
    sentences = d.each(f"({_source(d)})" + (" t" if d.name == "spark" else ""), careful_sentences(d), "s", "piece")
    marker = "coalesce(" + ", ".join(f"nullif({d.first('piece', ci(p))}, '')" for p in CLAIMS) + ")"
    cite = "coalesce(" + ", ".join(f"nullif({d.first('piece', p)}, '')" for p in CITATIONS.values()) + ")"
    sentence = f"{trimmed(d, 'piece')} AS sentence, " if more else ""
    if d.name == "spark":
        rows = f"(SELECT doc_id, text, lower(text) AS low FROM ({_source(d)}) t) t LATERAL VIEW explode({_claim_array(d)}) AS c"
        return f"""SELECT *, citation IS NOT NULL AS has_citation FROM (
  SELECT doc_id, {sentence}{big("s")} AS sentence_no, {marker} AS marker, {cite} AS citation FROM (SELECT doc_id, c.s AS s, c.x AS piece FROM {rows}) t) t"""
    return f"""SELECT doc_id, {sentence}{big("s")} AS sentence_no, {marker} AS marker, {cite} AS citation, {cite} IS NOT NULL AS has_citation
FROM {sentences} WHERE length({trimmed(d, "piece")}) > 20 AND {marker} IS NOT NULL"""


def claims(d) -> str:
    return _claims(d)


def unsupported_claims(d) -> str:
    return f"SELECT doc_id, sentence_no, marker FROM ({_claims(d)}) c WHERE NOT has_citation"


# Worth of a source by its type, of other types, and of a source without one.
TIERS = {"global_academic": 1.0, "institutional": 0.9, "arxiv": 0.8, "openalex": 0.9, "crossref": 0.9, "wikipedia": 0.55, "web": 0.45}
OTHER_TIER, UNTYPED = 0.6, "institutional"
#: Types given to the corpus items in turn, as the tables have none.
TYPES = (*TIERS, "scholarly_article", None)


def source_quality(d) -> str:
    """Mean worth in percent of the sources that a document overlaps."""
    kind = f"CASE source_id % {len(TYPES)} " + " ".join(f"WHEN {k} THEN '{t or UNTYPED}'" for k, t in enumerate(TYPES)) + " END"
    worth = "CASE kind " + " ".join(f"WHEN '{t}' THEN {100 * v:g}" for t, v in TIERS.items()) + f" ELSE {100 * OTHER_TIER:g} END"
    return f"""SELECT doc_id, {big("count(*)")} AS sources, {d.round(f"avg({dbl(worth)})", 1)} AS source_quality
FROM (SELECT doc_id, {kind} AS kind FROM ({overlap_by_source(d)}) o) k GROUP BY doc_id"""


def evidence_score(d) -> str:
    """Claim coverage (0.5), link rate (0.3) and source quality (0.2), renormalised over those that are known."""
    coverage = d.round("100.0 * c.cited / c.n", 1)
    link = d.round("100.0 * l.linked / l.citations", 1)
    weights = {"coverage": "0.5", "link_rate": "0.3", "source_quality": "0.2"}
    total = " + ".join(f"coalesce({dbl(w)} * {name}, 0)" for name, w in weights.items())
    known = " + ".join(f"CASE WHEN {name} IS NULL THEN {dbl('0')} ELSE {dbl(w)} END" for name, w in weights.items())
    tail = f"""s AS (SELECT *, CASE WHEN {known} > 0 THEN {d.round(f"({total}) / ({known})", 1)} END AS evidence FROM m)
SELECT doc_id, coverage AS claim_coverage, link_rate, source_quality, {dbl("evidence")} AS evidence_score,
  CASE WHEN evidence IS NULL THEN 'Not enough evidence data' WHEN evidence >= 85 THEN 'Strong structural coverage' WHEN evidence >= 60 THEN 'Partial structural coverage' ELSE 'Coverage needs review' END AS band FROM s"""
    if d.name == "spark":  # claims and links of a text are counted in its row
        cited = " OR ".join(d.lowered({"s.x": "s.low"}).like("s.x", p) for p in CITATIONS.values())
        return f"""WITH parts AS ({_parts(d)}), t AS (SELECT doc_id, cites, {_claim_array(d)} AS claims FROM ({_cited(d)}) t),
c AS (SELECT doc_id, {dbl("size(claims)")} AS n, {dbl(f"size(filter(claims, s -> {cited}))")} AS cited, {dbl("size(cites)")} AS citations, {dbl("size(filter(cites, s -> s.linked))")} AS linked FROM t),
l AS (SELECT doc_id, CASE WHEN n > 0 THEN {dbl(coverage)} END AS coverage, CASE WHEN citations > 0 THEN {dbl(link.replace("l.", "c."))} END AS link_rate FROM c),
m AS (SELECT l.*, q.source_quality FROM l LEFT JOIN ({source_quality(d)}) q ON l.doc_id = q.doc_id),
{tail}"""
    return f"""WITH c AS (SELECT doc_id, {dbl("count(*)")} AS n, {dbl("sum(CASE WHEN has_citation THEN 1 ELSE 0 END)")} AS cited FROM ({_claims(d)}) x GROUP BY doc_id),
l AS (SELECT doc_id, {dbl("citations")} AS citations, {dbl("linked")} AS linked FROM ({citation_links(d)}) y),
m AS (SELECT l.doc_id, {dbl(coverage)} AS coverage, CASE WHEN l.citations > 0 THEN {dbl(link)} END AS link_rate, q.source_quality
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id LEFT JOIN ({source_quality(d)}) q ON l.doc_id = q.doc_id),
{tail}"""


def identifier_routes(d) -> str:
    """What a citation request names: a DOI anywhere in it, else an arXiv number, else a title. Requests are made up from the corpus."""
    request = f"CASE item_id % 4 WHEN 0 THEN 'https://doi.org/10.1000/item.' || item_id WHEN 1 THEN 'arXiv:2101.0000' || item_id % 10 WHEN 2 THEN ' see 1706.03762v2 ' ELSE substring(text, 1, 80) END"
    doi, arxiv = d.first("request", r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"), d.first("request", r"\d{4}\.\d{4,5}")
    return f"""SELECT item_id, CASE WHEN {doi} <> '' THEN 'doi' WHEN {arxiv} <> '' THEN 'arxiv' ELSE 'title' END AS kind,
  CASE WHEN {doi} <> '' THEN {doi} WHEN {arxiv} <> '' THEN {arxiv} ELSE {trimmed(d, "request")} END AS identifier FROM (SELECT item_id, {request} AS request FROM benchmark) r"""


def informal_terms(d) -> str:
    """The first twelve informal terms of a text, by the order of the list and then of the text, with 25 characters on either side and formal wordings."""
    rows = []
    for k, term in enumerate(INFORMAL):
        pattern = ci(rf"\b{term}\b")
        guard = d.like("text", pattern)
        found = d.each(f"(SELECT doc_id, text, {d.all('text', pattern)} AS found, {d.split('text', pattern)} AS pieces FROM injected WHERE {guard}) x", "found", "i", "term")
        rows.append(f"SELECT doc_id, text, {k} AS k, i, term, '{', '.join(INFORMAL[term])}' AS wordings, length({d.at('pieces', 'i')}) AS lead, length(term) AS own FROM {found}")
    return f"""WITH injected AS ({_source(d)}), found AS ({" UNION ALL ".join(rows)}),
placed AS (SELECT *, sum(lead + own) OVER (PARTITION BY doc_id, k ORDER BY i) - own AS low FROM found),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, low) AS place FROM placed)
SELECT doc_id, {big("place")} AS place, term, {big("low")} AS start_offset, '...' || replace(substring(text, CAST(greatest(0, low - 25) AS INT) + 1, CAST(low + own + 25 - greatest(0, low - 25) AS INT)), {d.char(10)}, ' ') || '...' AS snippet, wordings FROM r WHERE place <= 12"""


def _openings(d) -> str:
    """doc_id, label, opening and front matter of the injected texts.

    The opening begins behind the first abstract or introduction header, else
    at the first prose marker, else at the first paragraph of 20 words with a
    sentence mark; it ends at the next section's header or after 5000
    characters. The front matter ends at the first header or marker, or after
    1500 characters.
    """
    header = OPENING_HEAD.format("(?:abstract|introduction)")
    rest = d.first("text", f"(?ims){header}(.*)", 1)
    named = d.first("text", f"(?im){OPENING_HEAD.format('(abstract|introduction)')}", 1)
    prose = d.first("text", rf"(?is)\b({OPENING_PROSE}.*)", 1)
    before = lambda text, pattern: d.at(d.split(text, pattern), "0")
    stop = f"(?im){OPENING_HEAD.format(OPENING_STOP)}"
    pieces = d.each(f"(SELECT doc_id, text, {d.split('text', PARAGRAPHS)} AS pieces, {d.all('text', PARAGRAPHS)} AS gaps FROM injected) x", "pieces", "s", "piece")
    return f"""WITH injected AS ({_source(d)}),
p AS (SELECT doc_id, s, piece, length(piece) AS own, length(coalesce({d.at("gaps", "s")}, '')) AS gap FROM {pieces}),
q AS (SELECT doc_id, s, sum(own + gap) OVER (PARTITION BY doc_id ORDER BY s) - own - gap AS low, {d.count("piece", PLAIN_WORD)} >= 20 AND {d.like("piece", "[.!?]")} AS fits FROM p),
f AS (SELECT doc_id, min(low) AS low FROM q WHERE fits GROUP BY doc_id),
r AS (
  SELECT t.doc_id, t.text, CASE WHEN {d.like("t.text", f"(?im){header}")} THEN lower({named.replace("text", "t.text")}) WHEN {d.like("t.text", rf"(?i){BOUND}{OPENING_PROSE}")} THEN 'opening prose'
    WHEN f.low IS NOT NULL THEN 'first substantial paragraph' ELSE 'not located' END AS label, f.low FROM injected t LEFT JOIN f ON t.doc_id = f.doc_id
),
o AS (SELECT doc_id, text, label, CASE WHEN label IN ('abstract', 'introduction') THEN {rest} WHEN label = 'opening prose' THEN {prose}
  WHEN label = 'not located' THEN '' ELSE substring(text, CAST(low AS INT) + 1) END AS rest FROM r)
SELECT doc_id, label, substring({trimmed(d, before("rest", stop))}, 1, 5000) AS opening,
  CASE WHEN {d.like("text", f"(?im){header}")} OR {d.like("text", rf"(?i){BOUND}{OPENING_PROSE}")} THEN
    substring(text, 1, least(length({before("text", f"(?im){header}")}), length({before("text", rf"(?i){BOUND}{OPENING_PROSE}")}))) ELSE substring(text, 1, 1500) END AS front FROM o"""


def openings(d) -> str:
    return f"SELECT doc_id, label, opening FROM ({_openings(d)}) o"


def thesis_score(d) -> str:
    """Points of the opening: 40, and more for a thesis, a method and a meaning."""
    points = " + ".join(f"CASE WHEN {d.like('opening', ci(p))} THEN {n} ELSE 0 END" for n, p in THESIS)
    return f"SELECT doc_id, label, {big(d.count('opening', PLAIN_WORD))} AS words, {big(f'CASE WHEN opening = {chr(39) * 2} THEN 0 ELSE 40 + {points} END')} AS score FROM ({_openings(d)}) o"


def anonymity(d) -> str:
    """Self-identifying patterns of the text and of its front matter, and a readiness score that loses 15 points for each, 45 at most, and 10 for each section of high cadence."""
    body = total(d, ANONYMITY)
    front = "(" + " + ".join(d.count("front", p) for p in FRONT_MATTER) + ")"
    return f"""WITH o AS ({_openings(d)}), t AS (SELECT doc_id, {big(body)} AS body_issues FROM {aliased(_rows(d))}),
h AS (SELECT doc_id, count(*) AS n FROM ({section_cadence(d)}) c WHERE cadence = 'High' GROUP BY doc_id),
n AS (SELECT t.doc_id, t.body_issues, {big(front)} AS front_issues, {big("coalesce(h.n, 0)")} AS high_sections FROM t JOIN o ON t.doc_id = o.doc_id LEFT JOIN h ON t.doc_id = h.doc_id),
s AS (SELECT *, {big("greatest(20, 100 - least(15 * (body_issues + front_issues), 45) - 10 * high_sections)")} AS readiness FROM n)
SELECT *, body_issues + front_issues = 0 AS compliant, CASE WHEN body_issues + front_issues = 0 THEN 'no_identifiers_detected' ELSE 'potential_identifiers_found' END AS status,
  CASE WHEN readiness >= 85 THEN 'success' WHEN readiness >= 60 THEN 'warning' ELSE 'danger' END AS badge FROM s"""


def section_cadence(d) -> str:
    """Words, sentences and mean sentence length of each section that a header line opens."""
    header = r"(?i)^\s*(?:#+|\d+\.|\*+)?\s*(abstract|introduction|related\s+work|methodology|experiments|results|conclusion|discussion)\s*[:#*]*\s*$"
    lines = d.each(f"({_source(d)})" + (" t" if d.name == "spark" else ""), d.split("text", r"\n"), "l", "line")
    return f"""WITH x AS (SELECT doc_id, l, line, {d.like("line", header)} AS head FROM {lines}),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY l) AS part FROM x),
s AS (SELECT doc_id, part, {d.joined("line", "l", " ")} AS body FROM g WHERE NOT head GROUP BY doc_id, part),
m AS (SELECT doc_id, part, {d.count("body", r"[^\s]+")} AS words, greatest(1, {d.count("body", r"[^.!?]*[^.!?\s][^.!?]*")}) AS sentences FROM s)
SELECT doc_id, {big("part")} AS section_no, {big("words")} AS words, {big("sentences")} AS sentences, {d.round(f'{dbl("words")} / sentences', 1)} AS mean_length,
  CASE WHEN words > 60 AND ({d.round(f'{dbl("words")} / sentences', 1)} > 24 OR {d.round(f'{dbl("words")} / sentences', 1)} < 8) THEN 'High' ELSE 'Low' END AS cadence FROM m WHERE words >= 15"""


PLANS = {
    f.__name__: f
    for f in (
        pattern_evidence, specificity, pattern_scores, top_signals, calibration, sanitized, mixed_script_words, citation_scan, bibliography_entries, citation_links,
        uncited_references, citations_without_reference, duplicate_references, alphabetized_references, link_checks, isbn_checks, claims, unsupported_claims,
        source_quality, evidence_score, identifier_routes, openings, thesis_score, anonymity, section_cadence,
    )
}
