"""Scalar functions: vector math, special functions, text and JSON forms, units, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.catalog.base import erfc_sql, query
from skytrace.catalog.scans import r, up
from skytrace.functions import special, vectors
from skytrace.sources import tables as tb


def _pairs(w):
    """Two 3-vectors per line item."""
    a = vectors.vec("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100)
    b = vectors.vec(F.col("l_tax") * 100, "l_linenumber", F.col("l_quantity") / 2)
    return w.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", a.alias("a"), b.alias("b"))


_V = """
FROM (SELECT *, l_quantity AS a1, l_extendedprice / 1000 AS a2, l_discount * 100 AS a3, l_tax * 100 AS b1, CAST(l_linenumber AS DOUBLE) AS b2, l_quantity / 2 AS b3 FROM lineitem)"""
_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_DOT, _NA, _NB = "(a1*b1 + a2*b2 + a3*b3)", "sqrt(a1*a1 + a2*a2 + a3*a3)", "sqrt(b1*b1 + b2*b2 + b3*b3)"


@query("fn_vector_math", f"""
SELECT {', '.join(_KEY)}, round(a2 + b2, 6) AS added, round(a3 - b3, 6) AS subtracted, round(a1 * 15e-1, 6) AS scaled, round(a2 / 4e0 + 1e-9, 6) AS divided,
       round(a2 * b2, 6) AS product, round({_DOT}, 6) AS dot, round({_NA}, 6) AS norm {_V}""")
def fn_vector_math(w):
    p, a, b = _pairs(w), F.col("a"), F.col("b")
    return p.select(
        *_KEY, r(vectors.add(a, b)[1], "added"), r(vectors.subtract(a, b)[2], "subtracted"), r(vectors.scale(a, 1.5)[0], "scaled"),
        up(vectors.divide(a, 4.0)[1], "divided"), r(vectors.diagonal_product(a, b)[1], "product"), r(vectors.dot(a, b), "dot"), r(vectors.norm(a), "norm"))


@query("fn_vector_tests", f"""
SELECT {', '.join(_KEY)}, round(acos(greatest(least({_DOT} / ({_NA} * {_NB}), 1e0), -1e0)), 5) AS angle,
       ((a1-b1)/20e0)*((a1-b1)/20e0) + ((a2-b2)/40e0)*((a2-b2)/40e0) + ((a3-b3)/10e0)*((a3-b3)/10e0) <= 1 AS within,
       sqrt((a1-b1)*(a1-b1) + (a2-b2)*(a2-b2) + (a3-b3)*(a3-b3)) < 30 AS closer, a1 = 0 AND a2 = 0 AND a3 = 0 AS is_null {_V}""")
def fn_vector_tests(w):
    p, a, b = _pairs(w), F.col("a"), F.col("b")
    return p.select(
        *_KEY, r(vectors.angle(a, b), "angle", 5), vectors.within_range(a, b, F.lit([20.0, 40.0, 10.0])).alias("within"),
        vectors.closer_than(a, b, 30.0).alias("closer"), vectors.is_null_vector(a).alias("is_null"))


@query("fn_index_of_first", f"""
SELECT {', '.join(_KEY)}, CAST(CASE WHEN l_linenumber = l_suppkey % 7 THEN 0 WHEN l_linenumber = l_partkey % 7 THEN 1 WHEN l_linenumber = l_orderkey % 7 THEN 2 ELSE -1 END AS INTEGER) AS idx
FROM lineitem""")
def fn_index_of_first(w):
    digits = F.array(*[(F.col(c) % 7).cast("bigint") for c in ("l_suppkey", "l_partkey", "l_orderkey")])
    return w.table("lineitem").select(*_KEY, vectors.index_of_first(digits, F.col("l_linenumber").cast("bigint")).alias("idx"))


@query("fn_erfc", f"SELECT event_id, round({erfc_sql('z')}, 12) AS tail FROM (SELECT event_id, value / 200e0 AS z FROM events)")
def fn_erfc(w):
    return w.table("events").select("event_id", r(special.erfc(F.col("value") / 200.0), "tail", 12))


@query("fn_vector_text", "SELECT scan, pid, '(' || CAST(y AS INTEGER) || '.0,' || CAST(x AS INTEGER) || '.0)' AS text, CAST(y AS DOUBLE) AS first, CAST(x AS DOUBLE) AS second FROM points")
def fn_vector_text(w):
    text = vectors.vector_to_text(vectors.vec("c_y", "c_x"))
    back = vectors.vector_from_text(text)
    return w.points.select("scan", "pid", text.alias("text"), back[0].alias("first"), back[1].alias("second"))


@query("fn_vector_json", "SELECT scan, pid, '[' || CAST(y AS INTEGER) || '.0,' || CAST(x AS INTEGER) || '.0]' AS json FROM points")
def fn_vector_json(w):
    return w.points.select("scan", "pid", vectors.vector_to_json(vectors.vec("c_y", "c_x")).alias("json"))


_SET = "list_sort(list_distinct([l_suppkey % 5, l_partkey % 5, l_orderkey % 5]))"


def _small_set(offset: int = 0):
    return F.array(*[((F.col(c) + offset) % 5).cast("bigint") for c in ("l_suppkey", "l_partkey", "l_orderkey")])


@query("fn_set_text", f"SELECT {', '.join(_KEY)}, '{{' || array_to_string({_SET}, ',') || '}}' AS text, CAST(len({_SET}) AS INTEGER) AS n FROM lineitem")
def fn_set_text(w):
    text = vectors.set_to_text(_small_set())
    return w.table("lineitem").select(*_KEY, text.alias("text"), F.size(vectors.set_from_text(text)).alias("n"))


@query("fn_map_text", f"""
SELECT {', '.join(_KEY)}, '[' || l_linenumber || ':{{' || array_to_string({_SET}, ',') || '}};' || (l_linenumber + l_orderkey + 1) || ':{{' || l_suppkey || '}};]' AS text,
       CAST(2 AS INTEGER) AS n FROM lineitem""")
def fn_map_text(w):
    entry = lambda key, ids: F.struct(key.cast("bigint").alias("key"), ids.alias("ids"))
    line = F.col("l_linenumber")
    text = vectors.map_to_text(F.array(entry(line + F.col("l_orderkey") + 1, F.array("l_suppkey")), entry(line, _small_set())))
    return w.table("lineitem").select(*_KEY, text.alias("text"), F.size(vectors.map_from_text(text)).alias("n"))


_SET2 = "[(l_suppkey + 1) % 5, (l_partkey + 1) % 5, (l_orderkey + 1) % 5]"


@query("fn_set_ops", f"""
SELECT {', '.join(_KEY)}, CAST(len(list_distinct(list_concat({_SET}, {_SET2}))) AS INTEGER) AS united, CAST(len(list_intersect({_SET}, {_SET2})) AS INTEGER) AS common,
       CAST(len(list_filter({_SET}, lambda x: NOT list_contains({_SET2}, x))) AS INTEGER) AS erased FROM lineitem""")
def fn_set_ops(w):
    a, b = _small_set(), _small_set(1)
    return w.table("lineitem").select(
        *_KEY, F.size(F.array_union(a, b)).alias("united"), F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_except(a, b)).alias("erased"))


@query("fn_assignments", "SELECT event_id, CAST(user_id AS DOUBLE) AS u, CAST(event_id AS DOUBLE) AS e FROM events")
def fn_assignments(w):
    text = F.concat(F.lit("u="), F.col("user_id").cast("string"), F.lit(", e="), F.col("event_id").cast("string"))
    parsed = vectors.assignments_from_text(text)
    return w.table("events").select("event_id", parsed["u"].alias("u"), parsed["e"].alias("e"))


@query("fn_config_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_config_path(w):
    return w.table("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("fn_capitalize", "SELECT s_suppkey, upper(substr(s_name, 1, 1)) || substr(s_name, 2) AS name FROM supplier")
def fn_capitalize(w):
    words = F.transform(F.split("s_name", " "), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))))
    return w.table("supplier").select("s_suppkey", F.array_join(words, " ").alias("name"))


@query("fn_units", "SELECT scan, pid, c_y * 1000 AS y_m, round(v - 27315e-2, 6) AS celsius, round(c_x * 1000 / 60e0, 6) AS speed FROM points")
def fn_units(w):
    return w.points.select("scan", "pid", (F.col("c_y") * 1000).alias("y_m"), r(F.col("v") - 273.15, "celsius"), r(F.col("c_x") * 1000 / 60.0, "speed"))
