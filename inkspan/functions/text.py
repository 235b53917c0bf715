"""Tokenizers and splitters as expressions of either dialect."""

from __future__ import annotations

import re
from re import _parser as parser

MATCH_WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_\s]"
PATTERN_WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z]+)?"
READING_WORD = r"[A-Za-z0-9'-]+"
PLAIN_WORD = r"[^\s]+"
PATTERN_SENTENCE = r"[^.!?\n]+[.!?]*"
MARK = r"\x01"


def match_words(d, text: str = "text") -> str:
    """Runs of letters, digits and underscores, lower-cased."""
    return d.all(f"lower({text})", MATCH_WORD)


def checker_words(d, text: str = "text") -> str:
    """Lower-cased, punctuation to spaces, split at spaces."""
    return d.all(d.replace(f"lower({text})", NOT_WORD, " "), PLAIN_WORD)


def marked_sentences(d, text: str = "text") -> str:
    """Pieces between sentence ends followed by spaces, or between blank lines."""
    ended = d.replace(text, r"([.!?])\s+", "<1>" + "\x01")
    return d.split(d.replace(ended, r"\n{2,}", "\x01"), MARK)


def careful_sentences(d, text: str = "text") -> str:
    """As `marked_sentences`, at blank lines with spaces on them too, and not after "et al."."""
    kept = d.replace(text, r"(?i)(et al\.)\s+", "<1>" + "\x02")
    ended = d.replace(kept, r"([.!?])\s+", "<1>" + "\x01")
    return d.split(d.replace(ended, r"\n\s*\n", "\x01"), MARK)


def trimmed(d, text: str) -> str:
    return d.replace(d.replace(text, r"^\s+", ""), r"\s+$", "")


def held(items) -> set[str] | None:
    """Of a parsed sequence, the most telling set of strings one of which every match holds."""
    options, run = [], ""
    for op, value in [*items, (None, None)]:
        letter = chr(value).lower() if op is parser.LITERAL else ""
        if letter and (letter.isascii() or letter == letter.upper()):
            run += letter
            continue
        options.append({run})
        run = ""
        if op is parser.SUBPATTERN:
            options.append(held(value[3]))
        elif op is parser.BRANCH:
            parts = [held(p) for p in value[1]]
            options.append(set().union(*parts) if all(parts) else None)
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0]:
            options.append(held(value[2]))
    telling = [o for o in options if o and all(len(p.strip()) > 2 or p.strip() and not re.search(r"\w", p) for p in o)]
    return max(telling, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def needed(regex: str) -> list[str]:
    """Lower-case strings one of which is in the lower-cased text of every match; empty if that can't be told."""
    try:
        return sorted(held(parser.parse(regex)) or ())
    except re.error:  # a pattern of another dialect
        return []


def begun(items) -> tuple[set[str], bool] | None:
    """Signs of ASCII, in lower case, one of which begins every match of a parsed sequence, and whether a match may be empty; None if that can't be told."""
    out: set[str] = set()
    for op, value in items:
        if op is parser.LITERAL and value < 128:
            own = {chr(value).lower()}, False
        elif op is parser.IN and all(o is parser.LITERAL and v < 128 for o, v in value):
            own = {chr(v).lower() for _, v in value}, False
        elif op is parser.SUBPATTERN:
            own = begun(value[3])
        elif op is parser.BRANCH:
            parts = [begun(p) for p in value[1]]
            own = None if None in parts else (set().union(*(p[0] for p in parts)), any(p[1] for p in parts))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            inner = begun(value[2])
            own = inner and (inner[0], inner[1] or not value[0])
        else:
            own = None
        if own is None:
            return None
        out |= own[0]
        if not own[1]:
            return out, False
    return out, True


def looked_for(regex: str) -> str:
    """What to put before a pattern that takes no notice of case, so that places where no match begins are passed by at their first sign; empty if that can't be told."""
    first = begun(parser.parse(regex))
    return "(?=[" + "".join(re.escape(c) for c in sorted(first[0])) + "])" if first and not first[1] else ""
