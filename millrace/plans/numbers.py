"""Mathematical functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import conditional as cond
from millrace.functions import numeric as num
from millrace.plans.registry import Catalogue

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


def _line(name, column, oracle):
    C.add(f"math_{name}", f"SELECT l_orderkey, l_linenumber, {oracle} AS v FROM lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", column().alias("v")))


_line("round", lambda: F.round("l_tax", 1), "round(l_tax, 1)")
_line("round_negative", lambda: F.round(F.col("l_partkey"), -2), "CAST(round(l_partkey, -2) AS BIGINT)")
_line("truncate", lambda: num.truncate(F.col("l_quantity") * -1.0, -1), "trunc(-l_quantity / 10.0) * 10.0")
_line("ceil", lambda: F.ceil(F.col("l_extendedprice")), "CAST(ceil(l_extendedprice) AS BIGINT)")
_line("floor", lambda: F.floor(F.col("l_extendedprice")), "CAST(floor(l_extendedprice) AS BIGINT)")
_line("pow", lambda: F.pow(F.col("l_quantity"), F.lit(2)), "pow(l_quantity, 2)")
_line("sqrt", lambda: F.round(F.sqrt(F.col("l_quantity")), 8), "round(sqrt(l_quantity), 8)")
_line("mod", lambda: num.modulo("l_partkey", F.lit(7).cast("long")), "l_partkey % 7")
_line("pi", lambda: F.round(F.pi() * F.col("l_quantity"), 6), "round(pi() * l_quantity, 6)")
_line("abs", lambda: F.abs(F.lit(25.0) - F.col("l_quantity")), "abs(25.0 - l_quantity)")
_line("sign", lambda: F.sign(F.lit(25.0) - F.col("l_quantity")), "CAST(sign(25.0 - l_quantity) AS DOUBLE)")
_line("exp_ln", lambda: F.round(F.ln(F.exp(F.col("l_quantity") / 10)), 6), "round(ln(exp(l_quantity / 10)), 6)")
_line("log10", lambda: F.round(F.log10(F.col("l_quantity")), 8), "round(log10(l_quantity), 8)")
_line("trigonometry", lambda: F.round(F.sin(F.col("l_quantity")) + F.cos(F.col("l_quantity")) + F.atan(F.col("l_quantity")), 8), "round(sin(l_quantity) + cos(l_quantity) + atan(l_quantity), 8)")
_line("degrees", lambda: F.round(F.degrees(F.radians(F.col("l_quantity"))), 6), "round(degrees(radians(l_quantity)), 6)")
_line("greatest", lambda: num.greatest_strict(F.col("l_quantity"), F.nullif("l_linenumber", F.lit(3)).cast("double")), "CASE WHEN l_linenumber = 3 THEN NULL ELSE greatest(l_quantity, l_linenumber) END")
_line("least", lambda: F.least(F.col("l_quantity"), F.col("l_linenumber").cast("double")), "least(l_quantity, l_linenumber::DOUBLE)")
_line("bit_count", lambda: F.bit_count("l_partkey"), "bit_count(l_partkey)::INTEGER")
_line("unsigned_wrap", lambda: cond.to_unsigned(-F.col("l_linenumber").cast("long")), "CAST(18446744073709551616::HUGEINT - l_linenumber AS DECIMAL(20,0))")
_line("zerofill", lambda: num.zerofill("l_linenumber", 5), "lpad(CAST(l_linenumber AS VARCHAR), 5, '0')")
_line("decimal_exact", lambda: (F.lit("0.1").cast("decimal(3,1)") + F.lit("0.2").cast("decimal(3,1)") == F.lit("0.3").cast("decimal(3,1)")).cast("int"), "1")
_line("double_inexact", lambda: (F.lit(0.1) + F.lit(0.2) == F.lit(0.3)).cast("int"), "0")


_line("truncate_decimal", lambda: num.truncate_exact(F.col("l_extendedprice").cast("decimal(14,2)") * F.lit(-1), 1).cast("decimal(14,1)"), "CAST(trunc(-CAST(l_extendedprice AS DECIMAL(14,2)) * 10) / 10 AS DECIMAL(14,1))")
_line("truncate_integer", lambda: num.truncate_exact(F.col("l_partkey"), -2).cast("long"), "l_partkey // 100 * 100")


@C.add("math_rand", "SELECT count(*) AS n, true AS in_range, true AS repeatable FROM nation")
def _(t):
    r = t.nation.select(F.rand(5).alias("a"), F.rand(5).alias("b"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and((F.col("a") >= 0) & (F.col("a") < 1)), F.lit(True)).alias("in_range"), F.coalesce(F.bool_and(F.col("a") == F.col("b")), F.lit(True)).alias("repeatable"))
