"""SQL text that Spark and DuckDB both run: the few functions they spell differently, and query registration.

A plan is a function of a dialect that returns one SELECT. Spark runs it over
the Parquet tables through `spark.sql`, where Catalyst plans it; the same plan
in DuckDB's spelling is the query's oracle.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspan.functions.text import looked_for, needed
from inkspan.functions.udfs import NAMED
from inkspan.sources.tables import read_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: What words are made of, and a place where a word begins or ends. Neither Java's nor DuckDB's own `\b` and `\w` see letters beyond
#: ASCII everywhere (Java's changed with version 19), so plans say them in full.
WORD_CHARS = r"\p{L}\p{N}_"
BEFORE, AFTER = rf"(?<![{WORD_CHARS}])", rf"(?![{WORD_CHARS}])"
BOUNDARY = rf"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"


def begins_word(rest: str) -> bool:
    """Whether all that `rest` of a pattern can match surely begins with a letter or digit of ASCII."""
    if re.match(r"[A-Za-z0-9]|\\d|\[[A-Za-z0-9-]+\]", rest):
        return not re.match(r".[*?]|\\d[*?]|\[[A-Za-z0-9-]+\][*?]", rest)
    if not re.match(r"\((?!\?[^:])", rest):
        return False
    depth, inside, firsts, i = 0, False, [], 0
    while i < len(rest):
        if rest[i] == "\\":
            i += 2
            continue
        inside = rest[i] == "[" or inside and rest[i] != "]"
        if not inside and rest[i] == "(":
            depth += 1
            if depth == 1:
                firsts.append(i + (3 if rest.startswith("(?:", i) else 1))
        elif not inside and rest[i] == "|" and depth == 1:
            firsts.append(i + 1)
        elif not inside and rest[i] == ")":
            depth -= 1
            if not depth:
                break
        i += 1
    return not re.match(r"[*?{]", rest[i + 1 :]) and all(begins_word(rest[f:i]) for f in firsts)


def spelled_out(regex: str, boundary: str, before: str | None = None, after: str | None = None) -> str:
    """The pattern with `\\w` as letters, digits and underscores of all scripts, and `\\b` as `boundary`; as `before` where a word surely begins, as `after` where one surely ends there."""
    out, inside, i = [], False, 0
    while i < len(regex):
        step = 2 if regex[i] == "\\" else 1
        part = regex[i : i + step]
        if part == "[" and not inside or part == "]" and inside:
            inside = not inside
        if part == r"\w":
            part = WORD_CHARS if inside else f"[{WORD_CHARS}]"
        elif part == r"\b":
            begins = before is not None and begins_word(regex[i + 2 :])
            ends = after is not None and re.search(r"(?:^|[^\\])[A-Za-z0-9]$", regex[:i])
            part = before if begins else after if ends else boundary
        out.append(part)
        i += step
    return "".join(out)


class Spark:
    name = "spark"
    #: Plans over injected texts (see plans.signals) read the documents as they are.
    plain = False
    #: Columns that hold other columns in lower case.
    lows: dict[str, str] = {}
    #: Sets of strings that an Arrow pass over column low has looked for (see `text_scan`); plans add theirs. None: each is looked for where it is needed.
    sought: list[tuple[str, ...]] | None = None

    def plainly(self):
        """The same dialect for plans over the documents as they are."""
        other = type(self)()
        other.plain = True
        return other

    def lowered(self, lows: dict[str, str]):
        """The same dialect for plans that have columns in lower case, by the columns' names."""
        other = copy.copy(self)
        other.lows = lows
        return other

    def searched(self, sought: list[tuple[str, ...]]):
        """The same dialect for plans that have `found`, what an Arrow pass found in column low."""
        other = copy.copy(self)
        other.sought = sought
        return other

    def pattern(self, regex: str) -> str:
        if regex.startswith(r"(?i)\b") and begins_word(regex[6:]):  # a place with another sign is passed by before what stands before it is looked at
            regex = "(?i)" + looked_for(regex[6:]) + regex[4:]
        regex = spelled_out(regex, BOUNDARY, BEFORE, AFTER)
        quote = '"' if '"' not in regex else "'"
        if quote in regex:
            regex = regex.replace(quote, "\\x22")
        return f"r{quote}{regex}{quote}"

    def seen(self, text: str) -> str:
        """The text as patterns with boundaries see it; plans with many such patterns name it `seen` once."""
        return text

    def guarded(self, text: str, regex: str, none: str, found: str) -> str:
        """`found` where a column holds a string that each match needs, `none` elsewhere: a plain search spares most texts the pattern."""
        parts = needed(regex) if re.fullmatch(r"[\w.]+|lower\([\w.]+\)", text) else []
        if not parts:
            return found
        return f"CASE WHEN NOT ({self.holds(text, parts)}) THEN {none} ELSE {found} END"

    def holds(self, text: str, parts: list[str]) -> str:
        """Whether a column in lower case holds one of these strings."""
        low = self.lows.get(text) or (text if text.startswith("lower(") else f"lower({text})")
        if self.sought is not None and low == "low":
            if tuple(parts) not in self.sought:
                self.sought.append(tuple(parts))
            return f"get(found.held, {self.sought.index(tuple(parts))})"
        quoted = ("'" + p.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'" for p in parts)
        return " OR ".join(f"contains({low}, {p})" for p in quoted)

    def count(self, text: str, regex: str) -> str:
        return self.guarded(text, regex, "0", f"regexp_count({text}, {self.pattern(regex)})")

    def all(self, text: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.pattern(regex)}, {group})"

    def first(self, text: str, regex: str, group: int = 0) -> str:
        return self.guarded(text, regex, "''", f"regexp_extract({text}, {self.pattern(regex)}, {group})")

    def like(self, text: str, regex: str) -> str:
        return self.guarded(text, regex, "false", f"{text} RLIKE {self.pattern(regex)}")

    def replace(self, text: str, regex: str, by: str) -> str:
        return f"regexp_replace({text}, {self.pattern(regex)}, {self.pattern(re.sub(r'<(\d)>', r'$\1', by))})"

    def marks_with(self, text: str, mark: str, neighbour: str, there: bool) -> str:
        """Number of marks with a match of `neighbour` on both sides, or on neither."""
        return self.count(text, f"(?<={neighbour}){mark}(?={neighbour})" if there else f"(?<!{neighbour}){mark}(?!{neighbour})")

    def spaced_dashes(self, text: str) -> str:
        """Number of double hyphens between single spaces with no hyphen beyond either."""
        return self.count(text, r"(?<!-)\s--\s(?!-)")

    def split(self, text: str, mark: str) -> str:
        return f"split({text}, {self.pattern(mark)}, -1)"

    def at(self, array: str, index: str) -> str:
        return f"get({array}, {index})"

    def head(self, array: str, count: int) -> str:
        return f"slice({array}, 1, {count})"

    def part(self, array: str, low: str, high: str) -> str:
        """Items from low up to, without, high, counted from 0."""
        return f"slice({array}, {low} + 1, greatest(0, {high} - {low}))"

    def size(self, array: str) -> str:
        return f"size({array})"

    def each(self, table: str, array: str, index: str, item: str) -> str:
        return f"{table} LATERAL VIEW posexplode({array}) AS {index}, {item}"

    def numbers(self, table: str, low: str, high: str, name: str) -> str:
        """Rows of `table` with `name` from low up to, without, high; none if high is not above low."""
        return f"{table} LATERAL VIEW explode(CASE WHEN {high} > {low} THEN sequence({low}, {high} - 1) ELSE array() END) AS {name}"

    def array(self, items) -> str:
        return f"array({', '.join(items)})"

    def join_words(self, array: str) -> str:
        return f"array_join({array}, ' ')"

    def char(self, code: int) -> str:
        return f"char({code})"

    def min_by(self, value: str, key: str) -> str:
        return f"min_by({value}, {key})"

    def distinct_size(self, array: str) -> str:
        return f"size(array_distinct({array}))"

    def joined(self, value: str, order: str, mark: str = ",") -> str:
        """Values of a group joined in the order of a non-null key."""
        return f"array_join(transform(array_sort(collect_list(struct({order} AS k, CAST({value} AS STRING) AS v))), x -> x.v), '{mark}')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def round(self, x: str, digits: int) -> str:
        """A double rounded as DuckDB does it, to a whole number of its multiple; Spark's own looks at the shortest decimal of the double, which the last bit of a product may put on the other side of a half."""
        return f"(round(CAST({x} AS DOUBLE) * {10**digits}D) / {10**digits}D)"

    text_type, double = "STRING", "DOUBLE"


class Duck(Spark):
    name = "duckdb"

    def pattern(self, regex: str) -> str:
        return "'" + spelled_out(regex, r"\b").replace("'", "''") + "'"

    def seen(self, text: str) -> str:
        """Boundaries see ASCII only here: underscores stand for other letters and digits."""
        return f"regexp_replace({text}, '[^\\P{{L}}\\x00-\\x7F]|[^\\P{{N}}\\x00-\\x7F]', '_', 'g')"

    def bounded(self, text: str, regex: str) -> str:
        return self.seen(text) if r"\b" in regex and text != "seen" else text

    def count(self, text: str, regex: str) -> str:
        return f"len(regexp_extract_all({self.bounded(text, regex)}, {self.pattern(regex)}))"

    def all(self, text: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract_all({text}, {self.pattern(regex)}, {group})"

    def first(self, text: str, regex: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.pattern(regex)}, {group})"

    def like(self, text: str, regex: str) -> str:
        return f"regexp_matches({self.bounded(text, regex)}, {self.pattern(regex)})"

    def replace(self, text: str, regex: str, by: str) -> str:
        return f"regexp_replace({text}, {self.pattern(regex)}, {self.pattern(re.sub(r'<(\d)>', r'\\\1', by))}, 'g')"

    def marks_with(self, text: str, mark: str, neighbour: str, there: bool) -> str:
        sides = (f"CASE WHEN i > 1 THEN substring({text}, i - 1, 1) ELSE '' END", f"substring({text}, i + 1, 1)")
        fits = " AND ".join(f"{'' if there else 'NOT '}regexp_matches({side}, '{neighbour}')" for side in sides)
        return f"len(list_filter(range(1, length({text}) + 1), lambda i: substring({text}, i, 1) = '{mark}' AND {fits}))"

    def spaced_dashes(self, text: str) -> str:
        # No lookaround here: each place is looked at with its neighbours, an empty string standing for the text's edge.
        fits = rf"regexp_matches(substring({text}, i, 4), '^\s--\s$') AND (i = 1 OR substring({text}, i - 1, 1) <> '-') AND substring({text}, i + 4, 1) <> '-'"
        return f"CASE WHEN contains({text}, '--') THEN len(list_filter(range(1, greatest(2, length({text}) - 2)), lambda i: {fits})) ELSE 0 END"

    def split(self, text: str, mark: str) -> str:
        return f"string_split_regex({text}, {self.pattern(mark)})"

    def at(self, array: str, index: str) -> str:
        return f"{array}[{index} + 1]"

    def head(self, array: str, count: int) -> str:
        return f"({array})[1:{count}]"

    def part(self, array: str, low: str, high: str) -> str:
        return f"({array})[{low} + 1 : {high}]"

    def size(self, array: str) -> str:
        return f"len({array})"

    def each(self, table: str, array: str, index: str, item: str) -> str:
        return f"(SELECT *, unnest({array}) AS {item}, generate_subscripts({array}, 1) - 1 AS {index} FROM {table})"

    def numbers(self, table: str, low: str, high: str, name: str) -> str:
        return f"(SELECT *, unnest(range(CAST({low} AS BIGINT), CAST({high} AS BIGINT))) AS {name} FROM {table})"

    def array(self, items) -> str:
        return f"[{', '.join(items)}]"

    def join_words(self, array: str) -> str:
        return f"array_to_string({array}, ' ')"

    def char(self, code: int) -> str:
        return f"chr({code})"

    def min_by(self, value: str, key: str) -> str:
        return f"arg_min({value}, {key})"

    def distinct_size(self, array: str) -> str:
        return f"len(list_distinct({array}))"

    def joined(self, value: str, order: str, mark: str = ",") -> str:
        return f"string_agg(CAST({value} AS VARCHAR), '{mark}' ORDER BY {order})"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def round(self, x: str, digits: int) -> str:
        return f"round({x}, {digits})"

    text_type = "VARCHAR"


SPARK, DUCK = Spark(), Duck()


def views(spark: SparkSession, sf_dir: str, sql: str) -> str:
    """The SQL with each table's name standing for a view over its Parquet files."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            view = f"inkspan_{name}_{abs(hash(sf_dir)):x}"
            read_table(spark, sf_dir, name).createOrReplaceTempView(view)
            sql = re.sub(rf"(\bFROM|\bJOIN) {name}\b(?!\s*\()", rf"\1 {view}", sql)
    for name in NAMED:
        if name in sql:
            spark.udf.register(name, NAMED[name]())
    return sql


def query(plan: Callable) -> Callable[[SparkSession, str], DataFrame]:
    sql = plan(SPARK)
    return lambda spark, sf_dir: spark.sql(views(spark, sf_dir, sql))


def register(queries: dict, oracles: dict, plans: dict[str, Callable]) -> None:
    for name, plan in plans.items():
        queries[name] = query(plan)
        oracles[name] = plan(DUCK)
