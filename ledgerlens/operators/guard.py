"""The guard before arbitrary SQL: read-only, known tables only, bounded results.

Statements are judged by the tree that Spark's own parser makes of them, so comma joins, quoted names, subqueries,
common table expressions and stacked statements are seen for what they are. Only what is named here passes: kinds of
plans and expressions, functions, and tables by their whole name. What a later version of Spark adds is rejected until it is named. A second,
lexical judgement, for statements of other dialects, reads tokens alone: words, numbers, literals, quoted names, comments and marks.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import COLUMNS, EPS_COLUMNS, MONEY_COLUMNS, PERCENT_COLUMNS

#: Words that make a statement more than a query, and the limits.
WRITES = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXECUTE", "EXEC", "CALL", "INTO"]
DEFAULT_ROWS, MOST_ROWS, SECONDS = 100, 1000, 30
TABLES = frozenset(COLUMNS)
_BEFORE_TABLES = frozenset(["FROM", "JOIN", "INTO", "UPDATE"])
NOT_READ_ONLY = "Only SELECT queries are allowed"


#: Kinds of plans and expressions that only read rows and compute, by their names in Spark's parser.
PLANS = frozenset("""
    Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation
    Pivot Project Sample Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation
    UnresolvedSubqueryColumnAliases UnresolvedWith Unpivot WithWindowDefinition
""".split())
EXPRESSIONS = frozenset("""
    Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat CreateArray CreateMap CreateNamedStruct
    Cube CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual GroupingSets ILike If In InSubquery IntegralDivide
    IsNotNull IsNull LambdaFunction LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower MultiAlias Multiply Not
    NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame StringLocate StringTrim
    StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive UnboundedFollowing$
    UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator
    UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression
    UnspecifiedFrame$ WindowExpression WindowSpecDefinition
""".split())
#: Functions of rows and groups. None reads files, settings or the session's user, or calls other code.
FUNCTIONS = frozenset("""
    abs acos asin atan atan2 cbrt ceil ceiling cos degrees div exp floor greatest least ln log log10 log2 mod negative pi pmod pow power
    radians round bround sign signum sin sqrt tan try_add try_divide try_multiply try_subtract width_bucket
    ascii btrim char char_length character_length concat concat_ws contains endswith format_number format_string initcap instr lcase left
    length levenshtein locate lower lpad ltrim overlay position regexp_count regexp_extract regexp_extract_all regexp_like regexp_replace
    regexp_substr repeat replace reverse right rpad rtrim split split_part startswith substr substring substring_index translate trim ucase upper
    add_months current_date current_timestamp date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth
    dayofweek dayofyear extract hour last_day make_date minute month months_between next_day now quarter second to_date to_timestamp
    trunc weekofyear year
    bigint boolean cast coalesce decimal double float if ifnull int isnan isnotnull isnull nanvl nullif nullifzero nvl nvl2 string try_cast
    try_to_number to_number zeroifnull between when
    any any_value approx_count_distinct approx_percentile array_agg avg bool_and bool_or collect_list collect_set corr count count_if
    covar_pop covar_samp every first first_value grouping grouping_id kurtosis last last_value listagg max max_by mean median min min_by mode
    percentile percentile_approx percentile_cont percentile_disc regr_count regr_intercept regr_r2 regr_slope skewness some std stddev
    stddev_pop stddev_samp string_agg sum try_avg try_sum var_pop var_samp variance
    cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number
    array array_contains array_distinct array_join array_max array_min array_sort element_at explode explode_outer filter inline map map_keys
    map_values named_struct posexplode size sort_array struct transform
""".split())
#: Names that stand for the session's own state where no column has them, and for files.
SESSION_NAMES = frozenset(["current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "current_path", "_metadata"])


class Rejected(ValueError):
    """The statement isn't allowed; the message says why."""


class Token(NamedTuple):
    kind: str  # word, number, literal, quoted, comment, space or mark
    text: str


#: The same cut for statements of ASCII, where the classes of regular expressions are those of the methods of texts.
_CUT = re.compile(r"""
    (?P<space>\s+) | (?P<word>[^\W\d]\w*) | (?P<number>\d+) | (?P<literal>'(?:[^']|\'\')*(?:'|\Z)) | (?P<quoted>"(?:[^"]|"")*(?:"|\Z))
    | (?P<comment>--[^\n]* | /\*(?s:.*?)(?:\*/|\Z)) | (?P<mark>(?s:.))
""", re.VERBOSE)


def tokens(sql: str) -> Iterator[Token]:
    """The statement cut into tokens, which give it again when joined; what is left open lasts to the end."""
    return (Token(m.lastgroup, m[0]) for m in _CUT.finditer(sql)) if sql.isascii() else _tokens(sql)


def _tokens(sql: str) -> Iterator[Token]:
    at, size = 0, len(sql)
    while at < size:
        c, end = sql[at], at + 1
        if c in "'\"":
            while end < size and (sql[end] != c or sql[end : end + 2] == c + c):
                end += 2 if sql[end] == c else 1
            end, kind = min(end + 1, size), "literal" if c == "'" else "quoted"
        elif sql.startswith(("--", "/*"), at):
            line = c == "-"
            stop = sql.find("\n" if line else "*/", at + 2)
            end, kind = size if stop < 0 else stop if line else stop + 2, "comment"
        else:
            kind = "space" if c.isspace() else "word" if c.isalpha() or c == "_" else "number" if c.isdigit() else "mark"
            same = {"space": str.isspace, "word": lambda x: x.isalnum() or x == "_", "number": str.isdigit}.get(kind)
            while same and end < size and same(sql[end]):
                end += 1
        yield Token(kind, sql[at:end])
        at = end


def _cut(sql: str | list[Token]) -> Iterable[Token]:
    return tokens(sql) if isinstance(sql, str) else sql


def without_comments(sql: str) -> str:
    return "".join(" " if t.kind == "comment" else t.text for t in tokens(sql))


def normalised(sql: str | list[Token]) -> str:
    """Without comments; white space between tokens becomes a single space, in literals and quoted names it stays. A statement is given as text or as its tokens, here and below."""
    out: list[str] = []
    for t in _cut(sql):
        if t.kind not in ("comment", "space"):
            out.append(t.text)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out).strip()


def is_read_only(sql: str | list[Token]) -> bool:
    """Whether it begins with SELECT and holds no writing word, even in a literal."""
    first, found = None, set()
    for t in _cut(sql):
        if t.kind == "word":
            first = first or t.text.upper()
            found.add(t.text.upper())
        elif t.kind in ("literal", "quoted"):
            first = first or t.kind
            found |= {w.text.upper() for w in tokens(t.text[1:-1]) if w.kind == "word"}
        elif t.kind in ("number", "mark"):
            first = first or t.kind
    return first == "SELECT" and found.isdisjoint(WRITES)


def named_tables(sql: str | list[Token]) -> set[str]:
    """Names after FROM, JOIN, INTO and UPDATE, without one leading schema, in lower case; quoted names aren't seen."""
    said = [t for t in _cut(sql) if t.kind != "comment"]
    found = set()
    for k, t in enumerate(said):
        if t.kind == "word" and t.text.upper() in _BEFORE_TABLES:
            after = [x for x in said[k + 1 : k + 5] if x.kind != "space"]
            kinds = [x.kind if x.kind != "mark" else x.text for x in after[:3]]
            if kinds[:1] == ["word"]:
                found.add(after[2 if kinds == ["word", ".", "word"] else 0].text.lower())
    return found


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


class _Reading:
    """What a parsed plan holds: the whole names of the relations it reads, and what in it isn't allowed."""

    def __init__(self, plan):
        self.tables: set[str] = set()
        self.kinds: set[str] = set()
        self.others: set[str] = set()
        self._plan(plan, frozenset())

    def _plan(self, plan, ctes: frozenset[str]) -> None:
        kind = plan.getClass().getSimpleName()
        if kind not in PLANS:
            self.kinds.add(kind)
            return
        if kind == "UnresolvedRelation":
            name = [p.lower() for p in _each(plan.multipartIdentifier())]
            if len(name) > 1 or name[0] not in ctes:
                self.tables.add(".".join(name))
        elif kind == "UnresolvedWith":
            for pair in _each(plan.cteRelations()):
                own = pair._1().lower()
                self._plan(pair._2(), ctes | {own} if plan.allowRecursion() else ctes)
                ctes = ctes | {own}
        for child in _each(plan.children()):
            self._plan(child, ctes)
        for expression in _each(plan.expressions()):
            self._expression(expression, ctes)

    def _expression(self, expression, ctes: frozenset[str]) -> None:
        kind = expression.getClass().getSimpleName()
        if kind not in EXPRESSIONS:
            self.others.add(kind)
            return
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self._plan(expression.plan(), ctes)
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            name = ".".join(_each(expression.nameParts())) if kind == "UnresolvedFunction" else expression.name().unquotedString()
            if name.lower() not in FUNCTIONS:
                self.others.add(name.lower())
        elif kind == "UnresolvedAttribute":
            self.others |= {p.lower() for p in _each(expression.nameParts())} & SESSION_NAMES
        for child in _each(expression.children()):
            self._expression(child, ctes)


def parsed(spark: SparkSession, sql: str):
    """What Spark's parser makes of one statement."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def parsed_tables(spark: SparkSession, sql: str) -> set[str]:
    """Whole names of all relations the parser finds, but common table expressions."""
    return _Reading(parsed(spark, sql)).tables


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the parser finds one statement, all of whose plans are known to read only."""
    return not _Reading(parsed(spark, sql)).kinds


def unknown_tables(tables: Iterable[str], allowed: Iterable[str] = TABLES) -> str | None:
    """What is wrong with these tables, if anything is."""
    bad = sorted(set(tables) - (TABLES if allowed is TABLES else {a.lower() for a in allowed}))
    return f"Access denied: tables not allowed: {', '.join(bad)}" if bad else None


def validate(sql: str, spark: SparkSession | None = None, allowed: Iterable[str] = TABLES) -> str | None:
    """Why the statement is rejected, or None. Without a session, by patterns alone; statements without tables pass."""
    if not sql or not sql.strip():
        return "Empty query"
    if spark is None:
        return NOT_READ_ONLY if not is_read_only(sql) else unknown_tables(named_tables(sql), allowed)
    text = without_comments(sql).strip().rstrip(";")
    try:
        found = _Reading(parsed(spark, text))
        if found.kinds:
            return NOT_READ_ONLY
        return unknown_tables(found.tables, allowed) or (f"Not allowed in a query: {', '.join(sorted(found.others))}" if found.others else None)
    except Exception as e:  # the parser's own errors come from the JVM in more than one class
        if not isinstance(e, (ParseException, PySparkException)) and "ParseException" not in str(e):
            raise
        return NOT_READ_ONLY if not is_read_only(sql) else "Syntax error"


def is_table_allowed(table: str) -> bool:
    return table.lower() in TABLES


def table_columns(table: str) -> list[str]:
    return list(COLUMNS.get(table.lower(), []))


def unknown_columns(table: str, columns: Iterable[str]) -> str | None:
    """What is wrong with these columns of a table, if anything is."""
    if not is_table_allowed(table):
        return f"Table not allowed: {table}"
    bad = sorted({c.lower() for c in columns} - set(table_columns(table)))
    return f"Columns not allowed in {table}: {', '.join(bad)}" if bad else None


def limited(sql: str) -> str:
    """With a LIMIT: the default if there is none; if the first asks for more than is allowed, all are set to that."""
    said = list(tokens(sql)) if "LIMIT" in sql.upper() else []
    rows = {}  # places of the numbers after LIMIT
    for k, t in enumerate(said):
        if t.kind == "word" and t.text.upper() == "LIMIT":
            after = next((j for j in range(k + 1, len(said)) if said[j].kind != "space"), None)
            if after is not None and said[after].kind == "number":
                rows[after] = int(said[after].text)
    if not rows:
        return f"{sql.rstrip(';').strip()} LIMIT {DEFAULT_ROWS}"
    if next(iter(rows.values())) <= MOST_ROWS:
        return sql
    return "".join(str(MOST_ROWS) if k in rows else t.text for k, t in enumerate(said))


def sanitised(sql: str) -> str:
    return limited(normalised(sql))


def run(spark: SparkSession, sql: str, allowed: Iterable[str] = TABLES) -> DataFrame:
    """The rows of an allowed statement; at most ``MOST_ROWS``, or ``DEFAULT_ROWS`` if it names no limit itself.

    The bound is put on the plan, not into the text, so that OFFSET and LIMITs of subqueries stay what they are.
    """
    if why := validate(sql, spark, allowed):
        raise Rejected(why)
    text = without_comments(sql).strip().rstrip(";").strip()
    bounded = parsed(spark, text).getClass().getSimpleName() == "GlobalLimit"
    try:
        return spark.sql(text).limit(MOST_ROWS if bounded else DEFAULT_ROWS)
    except (AnalysisException, ParseException) as e:
        raise Rejected(explained(e)) from e


def collect(df: DataFrame, seconds: float = SECONDS) -> list[dict]:
    """The few rows of a guarded query; its jobs are cancelled after ``seconds``."""
    context, group = df.sparkSession.sparkContext, f"guard-{id(df)}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "guarded query", True)
    timer.start()
    try:
        return [r.asDict(recursive=True) for r in df.collect()]
    except Exception as e:
        raise Rejected("Query timed out" if late.is_set() else explained(e)) from e
    finally:
        timer.cancel()
        context._jsc.clearJobGroup()


def explained(error: Exception) -> str:
    """A short reason for an error of a query."""
    text = str(error).lower()
    if isinstance(error, ParseException) or "syntax" in text or "parse_" in text:
        return "Query syntax error"
    if "timeout" in text or "timed out" in text or "cancelled" in text:
        return "Query timed out"
    if "connection" in text or "connect" in text:
        return "Database connection failed"
    return f"Query failed: {str(error).splitlines()[0][:200]}"


#: How the columns of each kind are shown, and which of them when there are many rows.
KINDS = {
    "${:,.0f}M": [*MONEY_COLUMNS],
    "{:.1f}%": [*PERCENT_COLUMNS, "percentage_of_total", "yoy_growth"],
    "${:.2f}": [*EPS_COLUMNS],
    "{:.0f}": ["fiscal_year"],
}
MAIN = ["ticker", "segment_name", "region", "category", "fiscal_year", "revenue", "net_income", "percentage_of_total"]
_FORMAT = {column: pattern for pattern, columns in KINDS.items() for column in columns}
MANY = 10


def shown(key: str, value: object) -> str:
    """A value as its column's kind is shown; as it is, if it's no number or the column has no kind."""
    pattern = _FORMAT.get(key)
    try:
        return str(value) if pattern is None else pattern.format(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return str(value)


def shown_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with these columns as text, each as its kind is shown; done in the JVM, rounding halves to even as ``shown`` does."""
    number = lambda c, digits: F.format_number(F.col(c).cast("double"), digits)
    plain = lambda text: F.translate(text, ",", "")
    kinds = {
        "${:,.0f}M": lambda c: F.concat(F.lit("$"), number(c, 0), F.lit("M")),
        "{:.1f}%": lambda c: F.concat(plain(number(c, 1)), F.lit("%")),
        "${:.2f}": lambda c: F.concat(F.lit("$"), plain(number(c, 2))),
        "{:.0f}": lambda c: plain(number(c, 0)),
    }
    return rows.withColumns({c: kinds[_FORMAT[c]](c) if c in _FORMAT else F.col(c).cast("string") for c in columns})


def _told(sql: str) -> tuple[str | None, str, str]:
    """What ``validate``, ``named_tables`` and ``sanitised`` say of a statement, which is cut into tokens once."""
    said = list(tokens(sql))
    tables = named_tables(said)
    verdict = "Empty query" if not sql.strip() else NOT_READ_ONLY if not is_read_only(said) else unknown_tables(tables)
    return verdict, ",".join(sorted(tables)), limited(normalised(said))


def judged(statements: DataFrame, column: str = "statement") -> DataFrame:
    """Adds ``verdict``, ``tables`` and ``sanitised`` to a table of statements: the lexical judgement, by batches in tasks.

    A statement takes far longer to judge than to move, and a log of many may be a file of few splits, so statements are dealt evenly first.
    """

    @F.pandas_udf("verdict string, tables string, sanitised string")
    def judge(sql: pd.Series) -> pd.DataFrame:
        told = [(None, None, None) if s is None else _told(s) for s in sql]
        return pd.DataFrame(told, columns=["verdict", "tables", "sanitised"], dtype=object)

    dealt = statements.repartition(int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("_judged", judge(F.col(column))).select("*", "_judged.*").drop("_judged")


def formatted(rows: list[dict], sql: str) -> str:
    """Rows as text, a line each, nulls left out: all columns of up to ``MANY`` rows, else the main columns of the first ones; at last the statement."""
    some = rows[:MANY]
    columns = MAIN if len(rows) > MANY else list(dict.fromkeys(k for r in some for k in r))
    lines = [", ".join(f"{k}: {shown(k, r[k])}" for k in columns if r.get(k) is not None) for r in some]
    head = "No rows match." if not rows else f"{len(rows)} row{'s' * (len(rows) > 1)}" + (f", of which the first {MANY}:" if len(rows) > MANY else ":")
    return "\n".join([head, *(f"{i}. {line}" for i, line in enumerate(lines, 1)), f"Statement: {sql}"])
