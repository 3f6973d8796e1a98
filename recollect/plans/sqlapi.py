"""A read-only SQL surface over named tables.

A statement is parsed by the session's own parser and run only if every node of
its tree is on a list of query nodes, every relation is a listed table or a common
table expression that is in scope, and every function is on a list; rewrites bring
LIKE, REGEXP and JSON access to the meaning that users of the surface expect.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, results

MAX_ROWS, DEFAULT_ROWS, CELL, QUERY, SECONDS = 200, 50, 500, 4_000, 10
#: Nodes of a parsed statement that only read.
NODES = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Union Intersect Except Join LateralJoin SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable OneRowRelation WithWindowDefinition Generate Pivot Unpivot Sample "
    "UnionLoop UnresolvedHint LocalRelation".split()
)
#: Functions that a statement may call: arithmetic, text, time, JSON, arrays and maps, aggregates and windows; none reaches outside of the statement.
FUNCTIONS = set(
    "abs acos asin atan atan2 bround cbrt ceil ceiling conv cos degrees e exp expm1 factorial floor greatest hypot least ln log log10 log1p log2 mod negative pi pmod "
    "positive pow power radians rint round sign signum sin sqrt tan try_add try_divide try_multiply try_subtract width_bucket bit_count shiftleft shiftright "
    "ascii base64 bit_length btrim char char_length character_length chr concat concat_ws contains endswith find_in_set format_number format_string hex ilike initcap instr lcase "
    "left length len levenshtein like locate lower lpad ltrim md5 octet_length overlay position printf regexp regexp_count regexp_extract regexp_extract_all regexp_instr "
    "regexp_like regexp_replace regexp_substr repeat replace reverse right rlike rpad rtrim sha sha1 sha2 soundex space split split_part startswith string substr substring "
    "substring_index translate trim ucase unbase64 unhex upper xxhash64 hash crc32 url_decode url_encode to_char to_number try_to_number "
    "add_months current_date current_timestamp date date_add date_diff date_format date_from_unix_date date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear "
    "extract from_unixtime hour last_day make_date make_timestamp minute month months_between next_day now quarter second timestamp timestamp_micros timestamp_millis "
    "timestamp_seconds to_date to_timestamp to_unix_timestamp trunc try_to_timestamp unix_date unix_micros unix_millis unix_seconds unix_timestamp weekday weekofyear year "
    "get_json_object json_array_length json_object_keys json_tuple from_json to_json schema_of_json parse_json try_parse_json variant_get try_variant_get "
    "array array_append array_compact array_contains array_distinct array_except array_intersect array_join array_max array_min array_position array_remove array_repeat "
    "array_size array_sort array_union arrays_overlap arrays_zip cardinality element_at explode explode_outer exists filter flatten forall get aggregate reduce sequence "
    "shuffle size slice sort_array transform zip_with inline posexplode posexplode_outer stack struct named_struct map map_entries map_filter map_from_arrays map_from_entries "
    "map_keys map_values str_to_map transform_keys transform_values try_element_at "
    "any any_value approx_count_distinct approx_percentile array_agg avg bit_and bit_or bit_xor bool_and bool_or collect_list collect_set corr count count_if covar_pop covar_samp "
    "every first first_value grouping grouping_id histogram_numeric kurtosis last last_value listagg max max_by mean median min min_by mode percentile percentile_approx "
    "percentile_cont percentile_disc regr_count regr_slope skewness some std stddev stddev_pop stddev_samp string_agg sum try_avg try_sum var_pop var_samp variance "
    "cume_dist dense_rank lag lead nth_value ntile percent_rank rank row_number "
    "bigint binary boolean cast double float int smallint tinyint coalesce if ifnull isnan isnotnull isnull nanvl nullif nullifzero nvl nvl2 zeroifnull equal_null assert_true "
    "typeof not and or between xor is".split()
) - {"assert_true"}


class Refused(ValueError):
    """The statement is no query over the listed tables."""


def literals(sql: str) -> list[str]:
    """The statement cut into text outside and inside quotes and comments, alternately."""
    return re.split(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.DOTALL)


def rewritten(sql: str) -> str:
    """x REGEXP 'p' in any case, LIKE in any case, json_extract as get_json_object."""
    parts = literals(sql)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"(?i)\bjson_extract\s*\(", "get_json_object(", parts[i])
        parts[i] = re.sub(r"(?i)(?<!i)\blike\b", "ILIKE", parts[i])
        if re.search(r"(?i)\bregexp\s*$", parts[i]) and i + 1 < len(parts) and parts[i + 1][0] in "'\"":
            parts[i] = re.sub(r"(?i)\bregexp\s*$", "RLIKE ", parts[i])
            parts[i + 1] = parts[i + 1][0] + "(?is)" + parts[i + 1][1:]
    return "".join(parts)


def each(seq) -> Iterator:
    """The items of a Scala collection."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def checked(plan, tables: set[str], scope: frozenset[str]) -> None:
    """Raises Refused unless the tree below plan only reads tables and what is in scope."""
    name = plan.nodeName()
    if name not in NODES:
        raise Refused(f"only queries are run, not {name}")
    if name == "UnresolvedRelation":
        parts = [p.lower() for p in each(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in tables | scope:
            raise Refused(f"no such table: {'.'.join(parts)}")
    if name == "UnresolvedWith":
        for pair in each(plan.cteRelations()):
            own = pair._1().lower()
            checked(pair._2(), tables, scope | {own} if plan.allowRecursion() else scope)
            scope = scope | {own}
    if name == "WithWindowDefinition":  # a map, which plan.expressions() leaves out
        for pair in each(plan.windowDefinitions()):
            expression(pair._2(), tables, scope)
    for e in each(plan.expressions()):
        expression(e, tables, scope)
    for child in each(plan.children()):
        checked(child, tables, scope)


def expression(e, tables: set[str], scope: frozenset[str]) -> None:
    """checked() for an expression: its functions, and the queries inside."""
    kind = e.getClass().getSimpleName()
    if kind.startswith(("UnresolvedFunction", "UnresolvedGenerator")):
        parts = [p.lower() for p in each(e.nameParts() if kind.startswith("UnresolvedFunction") else e.name().nameParts())] if kind.startswith("UnresolvedFunction") else [e.name().funcName().lower()]
        if len(parts) != 1 or parts[0] not in FUNCTIONS:
            raise Refused(f"no such function: {'.'.join(parts)}")
    elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        checked(e.plan(), tables, scope)
    elif "CallMethod" in kind or "Python" in kind or "Identifier" in kind.replace("UnresolvedAttribute", ""):
        raise Refused(f"not allowed: {kind}")
    for child in each(e.children()):
        expression(child, tables, scope)


def resolved(plan) -> None:
    """Raises Refused if the analysed plan calls what is outside of Spark's own functions: a second look, at what names have become."""
    for e in each(plan.expressions()):
        inner(e)
    for child in each(plan.children()):
        resolved(child)


def inner(e) -> None:
    kind = e.getClass().getSimpleName()
    if re.search("Reflect|CallMethod|Python|ScalaUDF|HiveSimple|HiveGeneric|InputFile|TryReflect", kind):
        raise Refused(f"not allowed: {kind}")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        resolved(e.plan())
    for child in each(e.children()):
        inner(child)


def unquoted(literal: str) -> str:
    """The value of a quoted string."""
    return literal[1:-1].replace(literal[0] * 2, literal[0])


def with_matches(sql: str, indexes: dict[str, Searched], views: dict[str, DataFrame]) -> str:
    """The statement with full-text search as tables: views gets them by name.

    fts_match('query') and fts_match('table', 'query') are tables (id, rank, snippet).
    For a table chunks with an index, chunks_fts is a table (rowid, rank, title, cwd,
    text) of what chunks_fts MATCH 'query' finds; bm25(chunks_fts) is its rank, and
    snippet(chunks_fts, ...) an excerpt. Rank falls as a match gets better.
    """
    parts = literals(sql)
    plain = list(range(0, len(parts), 2))
    asked: dict[str, str] = {}
    for i in plain:
        m = re.search(r"(?is)\b(?:(\w+)_fts)\s+match\s*$", parts[i])
        if m and i + 1 < len(parts) and parts[i + 1][0] in "'\"":
            table, query = m[1].lower(), unquoted(parts[i + 1])
            if table not in indexes:
                raise Refused(f"no index of {table}")
            if asked.setdefault(table, query) != query:
                raise Refused(f"{table}_fts is matched with two queries: use fts_match for one of them")
            parts[i], parts[i + 1] = parts[i][: m.start()] + " TRUE ", ""
    for i in plain:
        m = re.search(r"(?is)\bfts_match\s*\(\s*$", parts[i])
        if not m:
            continue
        given, j = [], i + 1
        while j < len(parts) and parts[j][:1] in ("'", '"'):
            given.append(unquoted(parts[j]))
            comma = re.match(r"\s*,\s*$", parts[j + 1])
            if not comma:
                break
            parts[j] = parts[j + 1] = ""
            j += 2
        end = re.match(r"\s*\)", parts[j + 1]) if given and j + 1 < len(parts) else None
        if not end or len(given) > 2:
            raise Refused("fts_match takes a query, or a table and a query, in quotes")
        table = given[0].lower() if len(given) == 2 else next(iter(indexes), "")
        if table not in indexes:
            raise Refused(f"no index of {table}")
        name = f"fts_match_{len(views)}"
        views[name] = indexes[table].found(given[-1]).select("id", "rank", "snippet")
        parts[i], parts[j], parts[j + 1] = parts[i][: m.start()] + name, "", parts[j + 1][end.end() :]
    for table, query in asked.items():
        views[f"{table}_fts"] = indexes[table].found(query).withColumnRenamed("id", "rowid")
        for i in plain:
            parts[i] = re.sub(rf"(?i)\bbm25\s*\(\s*{table}_fts\s*(?:,[\s\d.,]*)?\)", "rank", parts[i])
        text = "".join(parts)
        text = re.sub(rf"(?is)\bsnippet\s*\(\s*{table}_fts\b(?:[^()']|'[^']*')*\)", "snippet", text)
        parts = literals(text)
        plain = list(range(0, len(parts), 2))
    if re.search(r"(?i)\bmatch\b", "".join(parts[0::2])):
        raise Refused("MATCH stands after the name of an index and before a query in quotes")
    return "".join(parts)


class Searched(NamedTuple):
    """A table (id, title, cwd, text) and its full-text index."""

    index: fulltext.FullText
    table: DataFrame

    def found(self, query: str) -> DataFrame:
        """(id, rank, title, cwd, text, snippet) of what a query matches; texts are read for those rows alone."""
        try:
            asked, _ = fulltext.parsed(query)
            hits = self.index.match(query)
        except fulltext.Syntax as e:
            raise Refused(str(e)) from None
        terms = [w for c in asked for w in c.words]
        rows = self.table.select("id", "title", "cwd", "text").join(hits, "id")
        return rows.select("id", "rank", "title", "cwd", "text", results.excerpt(F.col("text"), terms, whole=True).alias("snippet") if terms else F.lit("").alias("snippet"))


def guarded(spark: SparkSession, sql: str, tables: set[str]) -> str:
    """The statement to run; Refused if it isn't a query over tables."""
    sql = rewritten(sql[:QUERY].strip().rstrip(";").strip())
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"not a statement: {str(e)[:200]}") from None
    checked(plan, {t.lower() for t in tables}, frozenset())
    return sql


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = DEFAULT_ROWS, seconds: float = SECONDS, indexes: dict[str, fulltext.FullText] | None = None) -> dict:
    """columns, rows (cells cut to CELL characters) and whether there were more; indexes: of tables by name, for MATCH and fts_match."""
    limit = max(1, min(limit, MAX_ROWS))
    df = query(spark, sql, tables, indexes)
    tag = f"sql-{threading.get_ident()}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    timer.start()
    try:
        rows = df.limit(limit + 1).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    cut = lambda v: v[:CELL] if isinstance(v, str) else v
    return {"columns": df.columns, "rows": [[cut(v) for v in r] for r in rows[:limit]], "truncated": len(rows) > limit}


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], indexes: dict[str, fulltext.FullText] | None = None) -> DataFrame:
    """What a statement over tables, and over the indexes of some of them, gives; Refused if it isn't a query over these alone."""
    views: dict[str, DataFrame] = {}
    held = {name.lower(): Searched(index, tables[name]) for name, index in (indexes or {}).items()}
    sql = with_matches(sql[:QUERY], held, views)
    for name, df in {**tables, **views}.items():
        df.createOrReplaceTempView(name)
    statement = guarded(spark, sql, {*tables, *views})
    df = spark.sql(statement)
    resolved(df._jdf.queryExecution().analyzed())
    return df
