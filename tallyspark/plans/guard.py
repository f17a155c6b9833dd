"""Read-only SQL over published views, checked on the parsed statement."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession


class QueryError(ValueError):
    """The request names something the catalog does not offer."""


# What a query may be made of; anything else (commands, table functions, scripts, hints) is refused.
_NODES = frozenset((
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable", "OneRowRelation",
    "WithWindowDefinition", "LateralJoin", "Pivot", "Unpivot",
))
_RELATION, _FUNCTION = "UnresolvedRelation", "UnresolvedFunction"
_FUNCTIONS = frozenset("""
abs add_months any_value approx_count_distinct array_agg array_distinct avg bool_and bool_or cast ceil ceiling char_length coalesce collect_list
collect_set concat concat_ws corr count count_if cume_dist current_date date date_add date_diff date_format date_sub date_trunc datediff day
dense_rank element_at every exp extract first first_value floor from_json get get_json_object greatest hour if ifnull initcap instr isnan isnotnull
isnull lag last last_day last_value lead least left length like ln log lower lpad ltrim make_date map_keys map_values max max_by mean median min
min_by minute mod month months_between nth_value ntile nullif nvl nvl2 percent_rank percentile percentile_approx pow power quarter rank
regexp_extract regexp_like regexp_replace replace right round row_number rpad rtrim sign size some split sqrt stddev stddev_pop stddev_samp
string_agg substr substring sum to_date to_json to_timestamp trim trunc try_cast try_divide upper variance week year
""".split())


def _items(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _check(node, names: set[str]) -> None:
    """Refuse a plan node, and all expressions and plans below it, that is not a query over the named relations."""
    kind = node.getClass().getSimpleName()
    inner = names
    if kind == "UnresolvedWith":
        # A name of a WITH clause is a relation for what follows it.
        inner = set(names)
        for part in _items(node.innerChildren()):
            _check(part, inner)
            inner.add(part.alias().lower())
    elif kind == _RELATION:
        parts = [part for part in _items(node.multipartIdentifier())]
        if len(parts) != 1 or parts[0].lower() not in names:
            raise QueryError(f"not published: {'.'.join(parts)}")
    elif kind not in _NODES:
        raise QueryError(f"not allowed in a query: {kind}")
    for expression in _items(node.expressions()):
        _check_expression(expression, inner)
    for child in _items(node.children()):
        _check(child, inner)


def _check_expression(node, names: set[str]) -> None:
    kind = node.getClass().getSimpleName()
    if kind == _FUNCTION:
        parts = [part for part in _items(node.nameParts())]
        if len(parts) != 1 or parts[0].lower() not in _FUNCTIONS:
            raise QueryError(f"function not allowed: {'.'.join(parts)}")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
        plans = [node.query().plan()] if kind == "InSubquery" else [node.plan()]
        for plan in plans:
            _check(plan, names)
    for child in _items(node.children()):
        if kind != "InSubquery" or child.getClass().getSimpleName() != "ListQuery":
            _check_expression(child, names)


def run_select(spark: SparkSession, views: dict[str, DataFrame], sql: str, limit: int | None = None) -> DataFrame:
    """One query over the published views by their names, all its rows unless a limit is given.

    Spark's own parser decides what the text is. Only query nodes, the views (unqualified), names of a WITH clause
    and plain functions pass. The views are bound to their names while the query is analysed.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise QueryError(f"not one SQL query: {error}") from None
    _check(plan, {name.lower() for name in views})
    # The caller's own temporary views of these names are put back afterwards.
    taken = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    saved = {name: spark.table(name) for name in views if name.lower() in taken}
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    try:
        rows = spark.sql(sql)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
        for name, view in saved.items():
            view.createOrReplaceTempView(name)
    return rows if limit is None else rows.limit(limit)
