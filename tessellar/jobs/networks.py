"""Queries on environments, gauges and variational fixed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import cells, environments, ising, maps, variational
from ..operators.contract import contract
from ..operators.tensor import Tensor
from ..sources.tables import CELL, lineitem_tensors, table
from .oracles import leading_value, product, tensor_sql
from .queries import query

#: Rows and columns of the Ising networks' unit cell, and their states' dimension.
SIDE, CHI = 2, 10


def _lift(t: Tensor) -> Tensor:
    """The one network that ``lineitem`` gives, as problem 0."""
    df = t.df.withColumn("problem", F.lit(0).cast("long"))
    return Tensor(df.select(*t.index, *cells.KEYS, "re", "im"), t.index, t.dims, cells.KEYS)


def _lineitem(spark: SparkSession, sf_dir: str, *names: str) -> list[Tensor]:
    lifted = map(_lift, lineitem_tensors(spark, sf_dir, names))
    return [t._with(cut(t.df)) for t in lifted]


def _holds(kind: str, slot: str, mapped: Tensor, x: Tensor, found: DataFrame, value: str) -> DataFrame:
    """Of each row or column the value's logarithm and angle, and whether ``mapped`` is ``value`` times ``x``, to 1e-8 of the value."""
    values = found.where(F.col("name") == value).select("problem", slot, F.element_at("re", 1).alias("u"), F.element_at("im", 1).alias("v"))
    scaled = x.df.join(values, ["problem", slot])
    scaled = scaled.select(*x.keys, (F.col("im") * F.col("v") - F.col("re") * F.col("u")).alias("re"), (F.lit(0.0) - F.col("re") * F.col("v") - F.col("im") * F.col("u")).alias("im"))
    rest = mapped.rename(*x.index).add(x._with(scaled)).norms()
    size = values.select("problem", slot, F.hypot("u", "v").alias("size"))
    joined = rest.join(size, ["problem", slot])
    held = joined.groupBy(F.col(slot).alias("slot")).agg((F.max(F.col("norm") / F.col("size")) < 1e-8).alias("holds"))
    numbers = values.select(F.col(slot).alias("slot"), F.round(F.log(F.hypot("u", "v")), 7).alias("size"), F.round(F.atan2("v", "u"), 7).alias("angle"))
    return held.join(numbers, "slot").select(F.lit(kind).alias("kind"), "slot", "size", "angle", "holds")


def _values_sql() -> str:
    """Leading values of the rows' and columns' products of maps, from traces of their powers; left and right maps have the same."""
    row, rows = leading_value("r", product([("AU", "abc"), ("M", "dgeb"), ("AD", "fgh", 1, 0)], "adf", "ceh"), "i", "j")
    centre, centres = leading_value("c", product([("FL", "adf"), ("M", "dgeb"), ("FR", "ceh")], "abc", "fgh"), "j", "i")
    bond, bonds = leading_value("b", product([("FL", "acd", 0, 1), ("FR", "bce")], "ab", "de"), "j", "i")
    one = lambda kind, of: f"SELECT '{kind}' AS kind, s AS slot, round(ln(sqrt(re * re + im * im)) / {CELL}, 7) AS size, round(atan2(im, re) / {CELL}, 7) AS angle, true AS holds FROM {of}"
    parts = [one("left", rows), one("right", rows), one("centre", centres), one("bond", bonds)]
    return f"WITH {', '.join([*row, *centre, *bond])} {' UNION ALL '.join(parts)}"


@query(_values_sql())
def env_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading eigenvalues of all four maps around their cycle, and whether the vectors, put back into their map as joins and sums, belong to them."""
    au, ad, m, fl, fr, c = _lineitem(spark, sf_dir, "AU", "AD", "M", "FL", "FR", "C")
    pack = cells.pack
    bulk = pack(m, "M")
    upper = pack(au, "AL").unionByName(pack(au, "AR")).unionByName(bulk)
    env = cut(environments.environments(upper, pack(ad, "AL").unionByName(pack(ad, "AR")), rows=CELL))
    parts = bulk.unionByName(pack(fl, "FL")).unionByName(pack(fr, "FR")).unionByName(pack(au, "AC")).unionByName(pack(c, "C"))
    centre = cut(environments.centres(parts, CELL))
    left, right = cells.unpack(env, "FL", "adf", (4, 2, 4)), cells.unpack(env, "FR", "ceh", (4, 2, 4))
    ac, bond = cells.unpack(centre, "AC", "abc", (4, 2, 4)), cells.unpack(centre, "C", "ab", (4, 4))
    low = maps.below(ad, CELL)
    return (
        _holds("left", "i", maps.left_map(left, au, m, low, CELL), left, env, "VL")
        .unionByName(_holds("right", "i", maps.right_map(right, au, m, low, CELL), right, env, "VR"))
        .unionByName(_holds("centre", "j", maps.centre_map(ac, fl, m, fr, CELL), ac, centre, "VA"))
        .unionByName(_holds("bond", "j", maps.bond_map(bond, fl, fr, CELL, CELL), bond, centre, "VC"))
    )


def _gauged(kind: str, one: Tensor, two: Tensor, found: DataFrame, factor: str) -> DataFrame:
    """Of each cell the logarithm of ``factor``, and whether it times ``one`` is ``two``."""
    size = found.where(F.col("name") == factor).select(*cells.KEYS, F.element_at("re", 1).alias("u"))
    scaled = one.df.join(size, list(cells.KEYS)).select(*one.keys, (F.lit(0.0) - F.col("re") * F.col("u")).alias("re"), (F.lit(0.0) - F.col("im") * F.col("u")).alias("im"))
    rest = two.add(one._with(scaled)).norms()
    return rest.join(size, list(cells.KEYS)).select(F.lit(kind).alias("kind"), "i", "j", F.round(F.log("u"), 7).alias("size"), (F.col("norm") < 1e-8 * F.col("u")).alias("holds"))


def _gauge_sql() -> str:
    """The factor is the root of the transfer map's leading value, which is real: traces of its powers, cell by cell."""
    cell = f"SELECT i * {CELL} + j AS i, 0 AS j, x.a || ',' || y.a AS x, x.c || ',' || y.c AS y, sum(x.re * y.re + x.im * y.im) AS re, sum(x.im * y.re - x.re * y.im) AS im FROM t x JOIN t y USING (i, j, b) GROUP BY ALL"
    steps, last = leading_value("g", f"WITH t AS ({tensor_sql('AU')}) {cell}", "i", "j", around=1)
    one = lambda kind: f"SELECT '{kind}' AS kind, (s // {CELL})::INT AS i, (s % {CELL})::INT AS j, round(ln(sqrt(re * re + im * im)) / 2, 7) AS size, true AS holds FROM {last}"
    return f"WITH {', '.join(steps)} {one('left')} UNION ALL {one('right')}"


@query(_gauge_sql())
def gauge_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isometries of each cell and the bond that carries the tensor into them."""
    (a,) = _lineitem(spark, sf_dir, "AU")
    packed = cells.pack(a, "A")
    left, right = cut(environments.left_orthogonal(packed)), cut(environments.right_orthogonal(packed))
    al, l = cells.unpack(left, "AL", "asb", (4, 2, 4)), cells.unpack(left, "L", "ab", (4, 4))
    ar, r = cells.unpack(right, "AR", "asb", (4, 2, 4)), cells.unpack(right, "R", "ab", (4, 4))
    a = a.rename("a", "s", "b")
    on = lambda x, y: contract((x.rename(*"asc"[: len(x.index)]) if len(x.index) == 3 else x.rename("a", "c"), y.rename("c", "b") if len(y.index) == 2 else y.rename("c", "s", "b")), "asb")
    return _gauged("left", on(al, l), on(l, a), left, "NL").unionByName(_gauged("right", on(r, ar), on(a, r), right, "NR"))


def _networks(betas: DataFrame, tensor) -> Tensor:
    """``problem`` (millionths of beta) and every cell of a uniform network."""
    slots = F.sequence(F.lit(0), F.lit(SIDE - 1))
    t = tensor(betas, "dgeb")
    df = t.df.withColumn("problem", F.round(F.col("beta") * 1e6).cast("long")).withColumn("i", F.explode(slots)).withColumn("j", F.explode(slots))
    return Tensor(df.select(*t.index, *cells.KEYS, "re", "im"), t.index, t.dims, cells.KEYS)


def _problems(rows: DataFrame, key: str, first: int = 500000) -> DataFrame:
    """Inverse temperatures (in millionths) from ``first`` on, in steps of 0.01, from the number of rows of each key."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select((F.lit(first) + F.pmod("n", F.lit(20)) * 10000).alias("problem")).distinct()


def _exact(problems: str, columns: str, first: int = 500000) -> str:
    """Onsager's solution, its integrals as sums over the midpoints of 2000 parts."""
    return f"""WITH p AS (SELECT DISTINCT ({first} + n % 20 * 10000)::BIGINT AS problem FROM ({problems})),
        b AS (SELECT problem, problem / 1e6 AS beta, 2 * sinh(2 * beta) / pow(cosh(2 * beta), 2) AS k FROM p),
        f AS (SELECT problem, beta, sqrt(1 - pow(k * sin((x + 0.5) * pi() / 4000), 2)) AS s FROM b, range(2000) r(x)),
        o AS (SELECT problem, any_value(beta) AS beta, avg(ln(1 + s)) AS u, avg(1 / s) AS v FROM f GROUP BY problem)
        SELECT problem, {columns} FROM o"""


_ENERGY = "-(1 + (2 * pow(tanh(2 * beta), 2) - 1) * v) / tanh(2 * beta)"


@query(_exact("SELECT count(*) AS n FROM customer GROUP BY c_nationkey", f"round(sqrt(2.0) * cosh(2 * beta) * exp(u / 2), 6) AS z, round({_ENERGY}, 6) AS energy, round(pow(1 - pow(sinh(2 * beta), -4), 0.125), 6) AS magnetization"))
def ising_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition function, energy and magnetisation per site, all temperatures in one sweep."""
    betas = cut(_problems(table(spark, sf_dir, "customer"), "c_nationkey").select((F.col("problem") / F.lit(1e6)).alias("beta")))
    bulk, magnetic, energy = (t._with(cut(t.df)) for t in (_networks(betas, f) for f in (ising.bulk, ising.magnetic, ising.energy)))
    state, _ = variational.solve_whole(variational.start(bulk, CHI, SIDE, SIDE), SIDE, SIDE, tol=1e-8)
    state = cut(state)
    env = cut(variational.observing(state, None, SIDE))
    value = lambda t, name, f: variational.expectation(state, env, t, bulk, CHI, SIDE).select("problem", F.round(f("re"), 6).alias(name))
    z = variational.partition_per_site(state, bulk, CHI, SIDE, SIDE).select("problem", F.round("z", 6).alias("z"))
    return z.join(value(energy, "energy", F.col), "problem").join(value(magnetic, "magnetization", F.abs), "problem")


@query(_exact("SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey", f"round({_ENERGY}, 4) AS energy"))
def num_grad_logz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the derivative of log z by central differences: both ends of each are problems of one sweep."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    problems = _problems(table(spark, sf_dir, "customer").join(nation, "c_nationkey"), "n_regionkey")
    step = 100
    ends = problems.select(F.explode(F.array(F.col("problem") - step, F.col("problem") + step)).alias("problem"))
    bulk = _networks(cut(ends.select((F.col("problem") / F.lit(1e6)).alias("beta"))), ising.bulk)
    bulk = bulk._with(cut(bulk.df))
    state, _ = variational.solve_whole(variational.start(bulk, CHI, SIDE, SIDE), SIDE, SIDE, tol=1e-9, maxiter=12)
    z = variational.partition_per_site(cut(state), bulk, CHI, SIDE, SIDE)
    middle = (F.round(F.col("problem") / 10000) * 10000).cast("long")
    slope = F.sum(F.log("z") * F.signum(middle - F.col("problem"))) / (2 * step / 1e6)
    return z.groupBy(middle.alias("problem")).agg(F.round(slope, 4).alias("energy"))


@query(_exact("SELECT count(*) AS n FROM supplier GROUP BY s_nationkey", f"round({_ENERGY}, 6) AS energy"))
def grad_logz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus the derivative of log z through the fixed point: its gradient by the network's entries times theirs by beta."""
    problems = _problems(table(spark, sf_dir, "supplier"), "s_nationkey")
    betas = cut(problems.select((F.col("problem") / F.lit(1e6)).alias("beta")))
    bulk, slope = (t._with(cut(t.df)) for t in (_networks(betas, f) for f in (ising.bulk, ising.bulk_slope)))
    state, _ = variational.solve_whole(variational.start(bulk, CHI, SIDE, SIDE), SIDE, SIDE, tol=1e-8)
    state = cut(state)
    by_entry = variational.gradient(state, cut(variational.observing(state, None, SIDE)), bulk, CHI, SIDE, SIDE)
    cell = contract((by_entry, slope)).df
    return cell.groupBy("problem").agg(F.round(0 - F.sum("re"), 6).alias("energy"))


def _tilted(t: Tensor, down: str, up: str) -> Tensor:
    """The same network with an invertible matrix between every two rows, and its inverse: seen from below it is another one."""
    out = t
    for leg, (a, b, c, e) in ((down, (2.0, 0.3, 0.1, 0.5)), (up, (0.5, -0.1, -0.3, 2.0))):
        # up legs take the transposed inverse, over the determinant 0.97
        over = 1.0 if leg == down else 0.97
        rows = [(0, 0, a / over), (0, 1, b / over), (1, 0, c / over), (1, 1, e / over)]
        x = out.df.sparkSession.createDataFrame(rows, "k int, l int, re double").withColumn("im", F.lit(0.0))
        joined = contract((out.rename(*("k" if n == leg else n for n in out.index)), Tensor(x, ("k", "l"), {"k": 2, "l": 2}, ())), tuple("l" if n == leg else n for n in out.index))
        out = joined.rename(*t.index)
    return Tensor(out.df, t.index, t.dims, t.batch)


@query(_exact("SELECT count(*) AS n FROM supplier GROUP BY s_nationkey", f"round({_ENERGY}, 5) AS energy", 150000))
def updown_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of networks that differ from above and from below: both boundary states, and environments between them.

    Above the critical temperature, so that both are of the one phase.
    """
    problems = _problems(table(spark, sf_dir, "supplier"), "s_nationkey", 150000)
    betas = cut(problems.select((F.col("problem") / F.lit(1e6)).alias("beta")))
    bulk, energy = (t._with(cut(t.df)) for t in (_tilted(_networks(betas, f), "g", "b") for f in (ising.bulk, ising.energy)))
    up, down, env = variational.observable_environment(bulk, CHI, SIDE, SIDE, tol=1e-8, maxiter=20)
    return variational.expectation(up, env, energy, bulk, CHI, SIDE, down).select("problem", F.round("re", 5).alias("energy"))


@query("SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS root FROM customer")
def fixedpoint_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton's square root of every balance by the iteration driver: a step is a projection, its error one aggregate."""

    def once(df: DataFrame) -> tuple[DataFrame, float]:
        new = cut(df.select("c_custkey", "x", F.when(F.col("x") == 0, 0.0).otherwise((F.col("y") + F.try_divide("x", "y")) / 2).alias("y"), F.col("y").alias("old")))
        return new.drop("old"), new.agg(F.coalesce(F.max(F.abs(F.col("y") - F.col("old")) / F.greatest(F.col("y"), F.lit(1.0))), F.lit(0.0)).alias("e")).first().e

    first = table(spark, sf_dir, "customer").select("c_custkey", F.abs("c_acctbal").alias("x"), F.greatest(F.abs("c_acctbal"), F.lit(1.0)).alias("y"))
    found, _ = variational.fixed_point(once, first, variational.Stop(1e-12, 60))
    return found.select("c_custkey", F.round("y", 6).alias("root"))


#: A small network for each supplier: bulk, upper and lower tensor, their indices as remainders by two.
_OWN = {
    "M": {"d": "l_partkey", "g": "l_orderkey", "e": "l_linenumber", "b": "l_quantity"},
    "AU": {"a": "l_partkey", "b": "l_quantity", "c": "l_orderkey"},
    "AD": {"f": "l_linenumber", "g": "l_orderkey", "h": "l_partkey"},
}


def _own_sql() -> str:
    """Of every supplier the left map as a matrix, and its leading value from traces of powers."""
    flag = "sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END)::DOUBLE"
    tensor = lambda name: f"SELECT l_suppkey AS p, {', '.join(f'{c}::BIGINT % 2 AS {k}' for k, c in _OWN[name].items())}, count(*)::DOUBLE AS re, {flag} AS im FROM lineitem GROUP BY ALL"
    half = f"SELECT u.p, a, c, d, g, e, sum(u.re * m.re - u.im * m.im) AS re, sum(u.re * m.im + u.im * m.re) AS im FROM ({tensor('AU')}) u JOIN ({tensor('M')}) m USING (p, b) GROUP BY ALL"
    whole = f"SELECT x.p AS i, 0 AS j, a || ',' || d || ',' || f AS x, c || ',' || e || ',' || h AS y, sum(x.re * y.re - x.im * y.im) AS re, sum(x.re * y.im + x.im * y.re) AS im FROM ({half}) x JOIN ({tensor('AD')}) y USING (p, g) GROUP BY ALL"
    steps, last = leading_value("w", whole, "i", "j", 6, around=1)
    return f"WITH {', '.join(steps)} SELECT s AS problem, round(ln(sqrt(re * re + im * im)), 6) AS size, round(atan2(im, re), 6) AS angle FROM {last}"


@query(_own_sql())
def supplier_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left environment's eigenvalue of every supplier's network: a group for each, as many as there are suppliers."""
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    two = lambda c: F.pmod(F.col(c).cast("int"), F.lit(2)).alias(c)
    names = sorted({c for index in _OWN.values() for c in index.values()})
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("problem"), *map(two, names), flag.alias("flag"))
    # one scan, summed map-side to at most 16 sums a supplier, from which the three tensors follow
    sums = cut(rows.groupBy("problem", *names).agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("flag")))

    def packed(name: str, *as_: str) -> DataFrame:
        index = _OWN[name]
        entries = sums.groupBy("problem", *(F.col(c).alias(k) for k, c in index.items())).agg(F.sum("n").cast("double").alias("re"), F.sum("flag").cast("double").alias("im"))
        t = Tensor(entries.select(*index, "problem", F.lit(0).alias("i"), F.lit(0).alias("j"), "re", "im"), tuple(index), dict.fromkeys(index, 2), cells.KEYS)
        once = cells.pack(t, as_[0])
        return once if len(as_) == 1 else once.unionByName(once.withColumn("name", F.lit(as_[1])))

    upper = packed("AU", "AL", "AR").unionByName(packed("M", "M"))
    found = environments.environments(upper, packed("AD", "AL", "AR"), rows=1, right=False).where("name = 'VL'")
    u, v = F.element_at("re", 1), F.element_at("im", 1)
    return found.select("problem", F.round(F.log(F.hypot(u, v)), 6).alias("size"), F.round(F.atan2(v, u), 6).alias("angle"))
