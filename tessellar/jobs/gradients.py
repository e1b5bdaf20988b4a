"""Queries on gradients, factors of tall matrices and the density scan, with SQL in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import adjoint, cells, differences, environments, krylov, maps, scan, tall
from ..operators.contract import contract
from ..operators.tape import Tape, norm_cotangent
from ..operators.tensor import Tensor, random_like
from ..sources.tables import CELL, lineitem_tensor, lineitem_tensors, table
from .networks import _lineitem
from .oracles import chain, cholesky, leading_value, product, tensor_sql
from .queries import query, ratio

_SUPPLIER = """e AS (SELECT l_suppkey AS problem, (l_linenumber % 2)::INT AS a, (l_partkey % 2)::INT AS b, count(*)::DOUBLE AS re,
    sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END)::DOUBLE AS im FROM lineitem GROUP BY ALL)"""


def _supplier_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small matrix for each supplier: entries count lines, the imaginary part returns less acceptances."""
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", -1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("problem"), F.pmod("l_linenumber", F.lit(2)).cast("int").alias("a"), F.pmod("l_partkey", F.lit(2)).cast("int").alias("b"), flag.alias("flag"))
    return rows.groupBy("problem", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("re"), F.sum("flag").cast("double").alias("im"))


@query(f"WITH {_SUPPLIER} SELECT problem, a, b, round(re / n, 4) + 0.0 AS re, round(im / n, 4) + 0.0 AS im FROM (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY problem)) AS n FROM e)")
def num_grad_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerical gradient of every supplier's norm by every entry of its matrix, in one sweep."""
    norm = lambda rows: rows.groupBy("problem").agg(F.sqrt(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("value"))
    out = differences.num_grad(norm, _supplier_matrices(spark, sf_dir), ("a", "b"))
    return out.select("problem", "a", "b", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@query("SELECT c_custkey AS problem, round(sign(c_acctbal) * sqrt(15.0::DOUBLE), 5) AS re FROM customer WHERE abs(c_acctbal) > 1")
def num_grad_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerical derivative by each customer's balance x (in thousands) of the norm of the matrix (x, 2x; 3x, x)."""
    x = table(spark, sf_dir, "customer").where(F.abs("c_acctbal") > 1).select(F.col("c_custkey").alias("problem"), (F.col("c_acctbal") / 1000).alias("re"))

    def norm(rows: DataFrame) -> DataFrame:
        entry = F.explode(F.array(*(F.col("re") * k for k in (1.0, 2.0, 3.0, 1.0))))
        return rows.select("problem", entry.alias("v")).groupBy("problem").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("value"))

    return differences.num_grad(norm, x, parts=1).select("problem", F.round("re", 5).alias("re"))


@query(f"""WITH t AS ({tensor_sql("AU")}), z AS (SELECT a, b, c, i, j, CASE WHEN i = 1 THEN 0 ELSE re END AS re, CASE WHEN i = 1 THEN 0 ELSE im END AS im FROM t)
    SELECT a, b, c, i, j, CASE WHEN n > 0 THEN round((1 + j) * re / n, 9) ELSE 0 END AS re, CASE WHEN n > 0 THEN round((1 + j) * im / n, 9) ELSE 0 END AS im
    FROM (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY i, j)) AS n FROM z)""")
def norm_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norm's rule with its guard: the cotangent of each cell's norm times the entry over the norm, 0 in the cells of a row that are 0."""
    au = lineitem_tensor(spark, sf_dir, "AU")
    x = au._with(au.df.withColumns({c: F.when(F.col("i") == 1, 0.0).otherwise(F.col(c)) for c in ("re", "im")}))
    scalars = x.norms().select("i", "j", F.col("norm").alias("re"), F.lit(0.0).alias("im"))
    norms = Tensor(scalars, (), {}, x.batch)
    seeds = Tensor(scalars.withColumn("re", F.col("j") + 1.0), (), {}, x.batch)
    out = norm_cotangent(x, norms, seeds).df
    return out.select(*x.keys, F.round("re", 9).alias("re"), F.round("im", 9).alias("im"))


_N = chain([("FL", "adf"), ("AU", "abc"), ("M", "dgeb"), ("AD", "fgh"), ("FR", "ceh")], "")
_D = chain([("C", "ab"), ("C", "ab")], "")
_AROUND = chain([("FL", "adf"), ("AU", "abc"), ("AD", "fgh"), ("FR", "ceh")], "dgeb")


@query(f"""WITH n AS ({_N}), m AS ({_D}), g AS ({_AROUND}),
    -- of |n / m| the derivative by an entry that n holds linearly: n / |n| conj(g) / |m|
    f AS (SELECT n.i, n.j, n.re / (sqrt(n.re * n.re + n.im * n.im) * sqrt(m.re * m.re + m.im * m.im)) AS u, n.im / (sqrt(n.re * n.re + n.im * n.im) * sqrt(m.re * m.re + m.im * m.im)) AS v FROM n JOIN m USING (i, j))
    SELECT d, g, e, b, i, j, round((u * re + v * im) / 1e6, 6) AS re, round((v * re - u * im) / 1e6, 6) AS im FROM g JOIN f USING (i, j)""")
def ratio_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape's gradient by the bulk tensor of the sum over cells of |n / m|: a five-tensor network over a bond's square (in millions)."""
    fl, au, m, ad, fr, c = _lineitem(spark, sf_dir, "FL", "AU", "M", "AD", "FR", "C")
    tape = Tape()
    nodes = {k: tape.leaf(t) for k, t in (("fl", fl), ("au", au), ("m", m), ("ad", ad), ("fr", fr), ("c", c))}
    n = tape.contract(((((nodes["fl"], nodes["au"]), nodes["m"]), nodes["ad"]), nodes["fr"]), ())
    loss = tape.total(tape.modulus(tape.divide(n, tape.contract((nodes["c"], nodes["c"]), ()))))
    (g,) = tape.gradient(loss, [nodes["m"]])
    return g.df.select("d", "g", "e", "b", "i", "j", F.round(F.col("re") / 1e6, 6).alias("re"), F.round(F.col("im") / 1e6, 6).alias("im"))


def _qr_cotangent_sql(sign: int) -> str:
    """Gram-Schmidt on two columns (``b``), and back through it; ``sign`` -1 takes conjugates going in and out."""
    im = "im" if sign > 0 else "0 - im"
    dot = lambda x, y: (f"sum({x}r * {y}r + {x}i * {y}i)", f"sum({x}r * {y}i - {x}i * {y}r)")
    over = "OVER (PARTITION BY i, j)"
    pick = lambda k, c, name: f"sum(CASE WHEN b = {k} THEN {c} ELSE 0 END) AS {name}"
    (sr, si), (tr, ti) = dot("p", "y"), dot("p", "w")
    return f"""WITH t AS (SELECT a, b, c, i, j, re, {im} AS im FROM ({tensor_sql("AU")})),
        k AS (SELECT c AS a, b, a AS c, i, j, re, im FROM t),
        x AS (SELECT a, c, i, j, {pick(0, "re", "xr")}, {pick(0, "im", "xi")}, {pick(1, "re", "yr")}, {pick(1, "im", "yi")} FROM t GROUP BY a, c, i, j),
        g AS (SELECT a, c, i, j, {pick(0, "re", "gr")}, {pick(0, "im", "gi")}, {pick(1, "re", "hr")}, {pick(1, "im", "hi")} FROM k GROUP BY a, c, i, j),
        w0 AS (SELECT *, sqrt(sum(xr * xr + xi * xi) {over}) AS n1 FROM x JOIN g USING (a, c, i, j)),
        w1 AS (SELECT *, xr / n1 AS pr, xi / n1 AS pi FROM w0),
        w2 AS (SELECT *, {sr} {over} AS sr, {si} {over} AS si FROM w1),
        w3 AS (SELECT *, yr - (pr * sr - pi * si) AS ur, yi - (pr * si + pi * sr) AS ui FROM w2),
        w4 AS (SELECT *, sqrt(sum(ur * ur + ui * ui) {over}) AS n2 FROM w3),
        w5 AS (SELECT *, ur / n2 AS qr, ui / n2 AS qi FROM w4),
        w6 AS (SELECT *, sum(qr * hr + qi * hi) {over} AS c2 FROM w5),
        w7 AS (SELECT *, (hr - qr * c2) / n2 AS wr, (hi - qi * c2) / n2 AS wi FROM w6),
        -- the cotangent of s = q1' a2
        w8 AS (SELECT *, 0 - ({tr} {over}) AS zr, 0 - ({ti} {over}) AS zi FROM w7),
        w9 AS (SELECT *, wr + (pr * zr - pi * zi) AS br, wi + (pr * zi + pi * zr) AS bi,
               gr - (wr * sr + wi * si) + (yr * zr + yi * zi) AS er, gi - (wi * sr - wr * si) + (yi * zr - yr * zi) AS ei FROM w8),
        w AS (SELECT *, sum(pr * er + pi * ei) {over} AS c1 FROM w9)
        SELECT a, 0 AS b, c, i, j, round((er - pr * c1) / n1, 7) AS re, round({sign} * (ei - pi * c1) / n1, 7) AS im FROM w
        UNION ALL SELECT a, 1 AS b, c, i, j, round(br, 7) AS re, round({sign} * bi, 7) AS im FROM w"""


def _factor_gradient(spark: SparkSession, sf_dir: str, left: bool) -> DataFrame:
    (au,) = _lineitem(spark, sf_dir, "AU")
    tape = Tape()
    x = tape.leaf(au)
    q, _ = tape.factors(x, "b", "y", left)
    turned = au.rename("c", "b", "a").conj().rename("c", "y", "a")
    loss = tape.total(tape.contract((q, tape.leaf(turned)), ()))
    (g,) = tape.gradient(loss, [x])
    return g.df.select("a", "b", "c", "i", "j", F.round("re", 7).alias("re"), F.round("im", 7).alias("im"))


@query(_qr_cotangent_sql(1))
def qr_cotangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back through the QR factors of each cell's tall matrix (columns ``b``): the gradient of re <K, Q>, K the tensor with its outer legs exchanged."""
    return _factor_gradient(spark, sf_dir, True)


@query(_qr_cotangent_sql(-1))
def lq_cotangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the LQ factors (rows ``b``)."""
    return _factor_gradient(spark, sf_dir, False)


_STEPS, _LAST = cholesky("AU", "c")


@query(f"{_STEPS} " + " UNION ALL ".join(f"SELECT a, b, {k} AS z, i, j, round(q{k}r, 8) AS re, round(q{k}i, 8) AS im FROM {_LAST}" for k in range(4)))
def tall_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q of each cell's matrix with columns ``c``, from the tree of small factors."""
    q, _ = tall.tall_qr(lineitem_tensors(spark, sf_dir, ("AU",))[0], "c")
    return q.df.select("a", "b", "z", "i", "j", F.round("re", 8).alias("re"), F.round("im", 8).alias("im"))


@query(f"{_STEPS} SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS z, {m} AS c, i, j, round(r{k}{m}r, 6) AS re, {'0.0' if k == m else f'round(r{k}{m}i, 6)'} AS im FROM {_LAST}" for k in range(4) for m in range(k, 4)) + ")")
def tall_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r = tall.tall_qr(lineitem_tensors(spark, sf_dir, ("AU",))[0], "c")
    return r.df.select("z", "c", "i", "j", F.round("re", 6).alias("re"), F.when(F.col("z") == F.col("c"), 0.0).otherwise(F.round("im", 6)).alias("im"))


_GRAM = f"t AS ({tensor_sql('AU')}), g AS (SELECT x.c AS a, y.c AS b, x.i, x.j, sum(x.re * y.re + x.im * y.im) AS re, sum(x.re * y.im - x.im * y.re) AS im FROM t x JOIN t y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.j = y.j GROUP BY ALL)"
_SQUARE = "SELECT x.a, y.b, x.i, x.j, sum(x.re * y.re - x.im * y.im) AS re, sum(x.re * y.im + x.im * y.re) AS im FROM {0} x JOIN {1} y ON x.b = y.a AND x.i = y.i AND x.j = y.j GROUP BY ALL"
_TRACE = "SELECT i, j, {0} AS p, round(ln(sum(re)), 9) AS moment FROM {1} WHERE a = b GROUP BY i, j"


@query(f"WITH {_GRAM}, g2 AS ({_SQUARE.format('g', 'g')}), g3 AS ({_SQUARE.format('g2', 'g')}), g4 AS ({_SQUARE.format('g2', 'g2')}) " + " UNION ALL ".join(_TRACE.format(p, n) for p, n in ((1, "g"), (2, "g2"), (3, "g3"), (4, "g4"))))
def singular_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of the sums of even powers of each cell's four singular values, which they determine: traces of the Gram matrix's powers."""
    _, s, _ = tall.svd(lineitem_tensors(spark, sf_dir, ("AU",))[0], "c")
    rows = s.select("i", "j", "s", F.explode(F.array(*(F.lit(p) for p in range(1, 5)))).alias("p"))
    return rows.groupBy("i", "j", "p").agg(F.round(F.log(F.sum(F.pow("s", 2 * F.col("p")))), 9).alias("moment"))


def _fold_sql() -> str:
    """The loop over columns, each from the one before."""
    ctes = [f"t AS ({tensor_sql('AU')})", f"r0 AS (SELECT a AS d, b AS c, i, re, im FROM ({tensor_sql('C')}) WHERE j = 0)"]
    for j in range(CELL):
        ctes.append(f"h{j} AS (SELECT x.d, y.b AS s, y.c AS b, x.i, sum(x.re * y.re - x.im * y.im) AS re, sum(x.re * y.im + x.im * y.re) AS im FROM r{j} x JOIN t y ON x.c = y.a AND x.i = y.i AND y.j = {j} GROUP BY ALL)")
        ctes.append(f"r{j + 1} AS (SELECT y.c AS d, x.b AS c, x.i, sum(x.re * y.re + x.im * y.im) AS re, sum(x.im * y.re - x.re * y.im) AS im FROM h{j} x JOIN t y ON x.d = y.a AND x.s = y.b AND x.i = y.i AND y.j = {j} GROUP BY ALL)")
    parts = " UNION ALL ".join(f"SELECT d AS a, c AS b, i, {(j + 1) % CELL} AS j, re, im FROM r{j + 1}" for j in range(CELL))
    return f"WITH {', '.join(ctes)} SELECT a, b, i, j, round(re / n, 9) AS re, round(im / n, 9) AS im FROM (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY i, j)) AS n FROM ({parts}))"


@query(_fold_sql())
def density_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The density matrix carried through all columns in order, over its norm: a scan of composed maps."""
    c, au = lineitem_tensors(spark, sf_dir, ("C", "AU"))
    out = scan.density_fold(c, au, CELL).normalized()
    return out.df.select("a", "b", "i", "j", F.round("re", 9).alias("re"), F.round("im", 9).alias("im"))


def _hashed(seed: int, index: dict[str, int], cells: str, batch: tuple[str, ...] = ("i", "j")) -> str:
    """SQL of ``random_like`` for the cells of a table."""
    unit = lambda part: f"('0x' || substr(md5(concat_ws(',', {seed}, '{part}', {', '.join((*index, *batch))})), 1, 8))::BIGINT::DOUBLE / 4294967296.0"
    ranges = ", ".join(f"(SELECT unnest(range({n}))::INT AS {k})" for k, n in index.items())
    return f"SELECT {', '.join((*index, *batch))}, {unit('re')} AS re, {unit('im')} AS im FROM (SELECT DISTINCT {', '.join(batch)} FROM ({cells})), {ranges}"


_SIX = {"a": 4, "b": 2, "c": 4, "t": 4, "u": 2, "v": 4}


@query(f"""WITH n AS ({chain([("AU", "abc"), ((_hashed(11, _SIX, tensor_sql("M")), tuple(_SIX)), "abctuv"), ("AU", "tuv")], "")}), m AS ({chain([("AU", "abc"), ("AU", "abc")], "")})
    SELECT i, j, round((n.re * m.re + n.im * m.im) / (m.re * m.re + m.im * m.im), 9) AS re, round((n.im * m.re - n.re * m.im) / (m.re * m.re + m.im * m.im), 9) AS im FROM n JOIN m USING (i, j)""")
def quadratic_form_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x S x over x x of every cell, S an operator with six indices from hashed numbers."""
    (au,) = lineitem_tensors(spark, sf_dir, ("AU",))
    s = random_like(au.df, _SIX, 11)
    return ratio(contract(((au, s), au.rename("t", "u", "v")), ()), contract((au, au), ()))


def _error_sql() -> str:
    x = tensor_sql("AU"), ("a", "b", "c")
    for _ in range(CELL):
        x = chain([("FL", "adf"), (x, "abc"), ("M", "dgeb"), ("FR", "ceh")], "fgh", i=1), ("f", "g", "h")
    part = chain([(x, "apc"), ("AD", "dpc", 0, 0, True), ("AD", "dsb")], "asb")
    return f"""WITH x AS ({x[0]}), p AS ({part}), r AS (SELECT x.i, x.j, x.re - p.re AS re, x.im - p.im AS im FROM x JOIN p ON x.f = p.a AND x.g = p.s AND x.h = p.b AND x.i = p.i AND x.j = p.j)
        SELECT i, j, round(ln(sqrt(sum(re * re + im * im))), 9) AS error FROM r GROUP BY i, j"""


@query(_error_sql())
def state_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the centre, carried down through all rows, a right state doesn't span: the logarithm of its norm in each cell."""
    au, fl, m, fr, ad = lineitem_tensors(spark, sf_dir, ("AU", "FL", "M", "FR", "AD"))
    down = maps.power_of_centre_map(au, fl, m, fr, CELL)
    down = down._with(cut(down.df))
    inside = maps.project(down, ad)
    rest = down.add(inside.rename(*down.index).scale(-1.0))
    return rest.norms().select("i", "j", F.round(F.log("norm"), 9).alias("error"))


def _substitution_sql() -> str:
    steps, last = cholesky("AU", "c")
    ctes = [f"r AS (SELECT DISTINCT i, j, {', '.join(f'r{k}{m}r, ' + ('0.0' if k == m else f'r{k}{m}i') + f' AS r{k}{m}i' for k in range(4) for m in range(k, 4))} FROM {last})"]
    picks = ", ".join(f"sum(CASE WHEN a = {k} THEN {p} ELSE 0 END) AS b{k}{p[0]}" for k in range(4) for p in ("re", "im"))
    ctes.append(f"y4 AS (SELECT b AS w, i, j, {picks} FROM ({tensor_sql('C')}) GROUP BY b, i, j)")
    for k in range(3, -1, -1):
        re = f"(b{k}r" + "".join(f" - (r{k}{m}r * x{m}r - r{k}{m}i * x{m}i)" for m in range(k + 1, 4)) + f") / r{k}{k}r"
        im = f"(b{k}i" + "".join(f" - (r{k}{m}r * x{m}i + r{k}{m}i * x{m}r)" for m in range(k + 1, 4)) + f") / r{k}{k}r"
        ctes.append(f"y{k} AS (SELECT *, {re} AS x{k}r, {im} AS x{k}i FROM " + (f"y{k + 1} JOIN r USING (i, j))" if k == 3 else f"y{k + 1})"))
    return f"{steps}, {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {k} AS c, w, i, j, round(x{k}r, 7) AS re, round(x{k}i, 7) AS im FROM y0" for k in range(4))


@query(_substitution_sql())
def triangular_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R x = b in every cell, R of the tall factors and b the bond tensor, two rows at a time."""
    au, c = lineitem_tensors(spark, sf_dir, ("AU", "C"))
    _, r = tall.tall_qr(au, "c")
    x = tall.back_substituted(r, c.rename("z", "w"), 2)
    return x.df.select("c", "w", "i", "j", F.round("re", 7).alias("re"), F.round("im", 7).alias("im"))


_FL, _FR = {"a": 4, "d": 2, "f": 4}, {"c": 4, "e": 2, "h": 4}
_CELLS = f"SELECT 0::BIGINT AS problem, i, j FROM ({tensor_sql('M')})"


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, {', '.join(f'{k} AS x{n}' for n, k in enumerate(index))}, i, j, re, im FROM ({_hashed(seed, index, _CELLS, ('problem', 'i', 'j'))})" for name, index, seed in (("FL", _FL, 100), ("FR", _FR, 101))))
def random_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The environments' first guesses from hashed numbers, packed by cell and taken apart again."""
    (m,) = _lineitem(spark, sf_dir, "M")
    found = cut(environments.random_environments(m.df, _FL, _FR))
    parts = [cells.unpack(found, name, tuple(index), tuple(index.values())).df.select(F.lit(name).alias("name"), *(F.col(k).alias(f"x{n}") for n, k in enumerate(index)), "i", "j", "re", "im") for name, index in (("FL", _FL), ("FR", _FR))]
    return parts[0].unionByName(parts[1])


def _around(fl: Tensor, fr: Tensor):
    """The bond's map once down through all rows, from row 0 back to it."""

    def apply(x: Tensor) -> Tensor:
        for _ in range(CELL):
            x = maps.bond_map(x, fl, fr, CELL, CELL).rename("a", "b")
        return x

    return apply


def _bond_sql() -> str:
    steps, last = leading_value("b", product([("FL", "acd", 0, 1), ("FR", "bce")], "ab", "de"), "j", "i")
    return f"WITH {', '.join(steps)} SELECT s AS j, round(ln(sqrt(re * re + im * im)), 7) AS size, round(atan2(im, re), 7) AS angle FROM {last}"


@query(_bond_sql())
def krylov_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bond map's leading eigenvalue of every column, by Arnoldi with vectors as tables."""
    c, fl, fr = lineitem_tensors(spark, sf_dir, ("C", "FL", "FR"))
    fl, fr = (t._with(cut(t.df)) for t in (fl, fr))
    values, _ = krylov.dominant(_around(fl, fr), c.fix("i", 0), ("j",), tol=1e-11, space=6)
    return values.select("j", F.round(F.log(F.hypot("vr", "vi")), 7).alias("size"), F.round(F.atan2("vi", "vr"), 7).alias("angle"))


@query(f"SELECT a, b, j, round(re, 5) AS re, round(im, 5) + 0.0 AS im FROM ({tensor_sql('C')}) WHERE i = 0")
def krylov_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bond tensor, found again by GMRES on tables from what the bond's map less twice the identity makes of it."""
    c, fl, fr = lineitem_tensors(spark, sf_dir, ("C", "FL", "FR"))
    fl, fr = (t._with(cut(t.normalized().df)) for t in (fl, fr))
    around = _around(fl, fr)
    shifted = lambda x: around(x).add(x.scale(-2.0))
    x, _ = krylov.solve(shifted, shifted(c.fix("i", 0)), ("j",), tol=1e-12, space=8)
    return x.df.select("a", "b", "j", F.round("re", 5).alias("re"), (F.round("im", 5) + 0.0).alias("im"))


def _root_sql() -> str:
    """The root of a 2 x 2 matrix in closed form, (A + sqrt(det) 1) / sqrt(trace + 2 sqrt(det)), at both ends of a small step along another matrix."""
    entry = lambda k: f"sum(CASE WHEN a = {k} THEN {{0}} ELSE 0 END)"
    wide = ", ".join(f"{entry(k).format(c)} AS {n}{k}" for k in (0, 1) for c, n in (("re", "r"), ("im", "s")))
    return f"""WITH {_SUPPLIER}, w AS (SELECT problem, b, {wide} FROM e GROUP BY problem, b),
        -- 1 + X'X over the rows, and the change: the rows' second half only
        g AS (SELECT problem, 1 + sum(r0 * r0 + s0 * s0) AS p, 1 + sum(r1 * r1 + s1 * s1) AS q, sum(r0 * r1 + s0 * s1) AS u, sum(r0 * s1 - s0 * r1) AS v,
              sum(b * (r0 * r0 + s0 * s0)) AS dp, sum(b * (r1 * r1 + s1 * s1)) AS dq, sum(b * (r0 * r1 + s0 * s1)) AS du, sum(b * (r0 * s1 - s0 * r1)) AS dv FROM w GROUP BY problem),
        m AS (SELECT problem, h, p + h * dp AS p, q + h * dq AS q, u + h * du AS u, v + h * dv AS v FROM g, (SELECT unnest([-1e-5::DOUBLE, 1e-5::DOUBLE]) AS h)),
        d AS (SELECT *, sqrt(p * q - u * u - v * v) AS t FROM m),
        s AS (SELECT problem, h, (p + t) / sqrt(p + q + 2 * t) AS p, (q + t) / sqrt(p + q + 2 * t) AS q, u / sqrt(p + q + 2 * t) AS u, v / sqrt(p + q + 2 * t) AS v FROM d)
        SELECT problem, round(sum(sign(h) * p) / 2e-5, 3) + 0.0 AS ds00, round(sum(sign(h) * q) / 2e-5, 3) + 0.0 AS ds11, round(sum(sign(h) * u) / 2e-5, 3) + 0.0 AS ds01_re, round(sum(sign(h) * v) / 2e-5, 3) + 0.0 AS ds01_im FROM s GROUP BY problem"""


@query(_root_sql())
def root_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of the root of each supplier's 1 + X'X along a matrix that doesn't commute with it, from Sylvester's equation."""
    x = cut(_supplier_matrices(spark, sf_dir).withColumns({"i": F.lit(0), "j": F.lit(0)}))
    dims = {"a": 2, "b": 2}
    matrix = lambda df: Tensor(df.select("a", "b", *cells.KEYS, "re", "im"), ("a", "b"), dims, cells.KEYS)
    square = lambda t: contract((t.conj().rename("x", "b"), t.rename("y", "b")), ("x", "y"))
    eye = Tensor(x.select(*cells.KEYS).distinct().withColumn("x", F.explode(F.array(F.lit(0), F.lit(1)))).select("x", F.col("x").alias("y"), *cells.KEYS, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), ("x", "y"), {"x": 2, "y": 2}, cells.KEYS)
    both = lambda t, name: cells.pack(Tensor(t.df, t.index, {"x": 2, "y": 2}, t.batch), name)
    zero = eye.scale(0.0)
    found = adjoint.matrix_roots(both(square(matrix(x)).add(eye), "A").unionByName(both(square(matrix(x.where("b = 1"))).add(zero), "DA")))
    entry = lambda k, part, name: (F.round(F.element_at(part, k), 3) + 0.0).alias(name)
    return found.where("name = 'DS'").select("problem", entry(1, "re", "ds00"), entry(4, "re", "ds11"), entry(2, "re", "ds01_re"), entry(2, "im", "ds01_im"))


_FORM = {"a": 4, "b": 4, "t": 4, "u": 4}


def _vector_gradient_sql(base: str, entries: str, keys: str, change: str, slot: str, order: str, form: dict[str, int], seed: int, step: float = 0.05) -> str:
    """Central differences of |x S x / x x| for the leading vectors x of the slots' products of maps, seen at the first place around.

    For every moved entry (``keys`` at ``i, j`` of ``entries``) its slot's maps
    around ``order``, with ``change`` (``i, x, y, ur, ui`` for entries ``m``) as
    what a unit of it adds; x from a power of their product; and the loss.
    """
    times = lambda u, v: f"SELECT u.p, u.x, v.y, sum(u.re * v.re - u.im * v.im) AS re, sum(u.re * v.im + u.im * v.re) AS im FROM {u} u JOIN {v} v ON u.p = v.p AND u.y = v.x GROUP BY ALL"
    scaled = lambda inner: f"SELECT p, x, y, re / sqrt(sum(re * re + im * im) OVER (PARTITION BY p)) AS re, im / sqrt(sum(re * re + im * im) OVER (PARTITION BY p)) AS im FROM ({inner})"
    half = len(form) // 2
    one, two = (" || ',' || ".join(list(form)[k : k + half]) for k in (0, half))
    ctes = [
        f"e AS MATERIALIZED ({base})",
        f"m AS MATERIALIZED (SELECT row_number() OVER () AS p, * FROM ({entries}), (SELECT unnest([0, 1]) AS part), (SELECT unnest([-1, 1]) AS side))",
        f"moved AS (SELECT p, place, x, y, {step / 2} * side * CASE WHEN part = 0 THEN ur ELSE 0 - ui END AS re, {step / 2} * side * CASE WHEN part = 0 THEN ui ELSE ur END AS im FROM ({change}))",
        f"all_e AS MATERIALIZED (SELECT p, place, x, y, sum(re) AS re, sum(im) AS im FROM (SELECT m.p, e.{order} AS place, x, y, re, im FROM m JOIN e USING ({slot}) UNION ALL SELECT p, place, x, y, re, im FROM moved) GROUP BY ALL)",
    ]
    ctes += [f"k{k} AS (SELECT p, x, y, re, im FROM all_e WHERE place = {k})" for k in range(CELL)]
    last = "k0"
    for k in range(1, CELL):
        ctes.append(f"w{k} AS MATERIALIZED ({times(last, f'k{k}')})")
        last = f"w{k}"
    ctes.append(f"q0 AS MATERIALIZED ({scaled(f'SELECT * FROM {last}')})")
    ctes += [f"q{k + 1} AS MATERIALIZED ({scaled(times(f'q{k}', f'q{k}'))})" for k in range(4)]
    ctes += [
        "v AS MATERIALIZED (SELECT p, y AS x, sum(re) AS re, sum(im) AS im FROM q4 GROUP BY ALL)",
        f"s AS (SELECT {one} AS x, {two} AS y, {slot}, re, im FROM ({_hashed(seed, form, tensor_sql('M'))}) WHERE {order} = 0)",
        f"vs AS (SELECT v.p, s.y, sum(v.re * s.re - v.im * s.im) AS re, sum(v.re * s.im + v.im * s.re) AS im FROM v JOIN m USING (p) JOIN s ON s.x = v.x AND s.{slot} = m.{slot} GROUP BY ALL)",
        "n AS (SELECT vs.p, sum(vs.re * v.re - vs.im * v.im) AS re, sum(vs.re * v.im + vs.im * v.re) AS im FROM vs JOIN v ON v.p = vs.p AND v.x = vs.y GROUP BY vs.p)",
        "d AS (SELECT p, sum(re * re - im * im) AS re, sum(2 * re * im) AS im FROM v GROUP BY p)",
        "l AS (SELECT p, sqrt((n.re * n.re + n.im * n.im) / (d.re * d.re + d.im * d.im)) AS loss FROM n JOIN d USING (p))",
    ]
    slope = lambda part: f"round(1e6::DOUBLE * sum(CASE WHEN part = {part} THEN side * loss ELSE 0 END) / {step}, 3) + 0.0"
    return f"WITH {', '.join(ctes)} SELECT {', '.join(keys)}, i, j, {slope(0)} AS re, {slope(1)} AS im FROM l JOIN m USING (p) GROUP BY ALL"


_UNIT = "x.re * y.re - x.im * y.im AS ur, x.re * y.im + x.im * y.re AS ui"
_BULK = f"SELECT d, g, e, b, i, j FROM ({tensor_sql('M')})"


def _gradient_by(g: Tensor) -> DataFrame:
    out = lambda k: (F.round(F.col(k) * 1e6, 3) + 0.0).alias(k)
    return g.df.select(*g.index, "i", "j", out("re"), out("im"))


def _overlap(tape: Tape, x, form: dict[str, int], cells_of: DataFrame, seed: int, axis: str):
    """The sum over slots of |x S x / x x| at the first place around, S from hashed numbers."""
    x = tape.fix(x, axis, 0)
    s = tape.leaf(random_like(cells_of.select("i", "j"), form, seed).fix(axis, 0))
    top = tape.contract(((x, s), tape.rename(x, *list(form)[len(form) // 2 :])), ())
    return tape.total(tape.modulus(tape.divide(top, tape.contract((x, x), ()))))


@query(_vector_gradient_sql(
    product([("FL", "acd", 0, 1), ("FR", "bce")], "ab", "de"), f"SELECT c, e, h, i, j FROM ({tensor_sql('FR')})", "ceh",
    f"SELECT m.p, side, part, m.i AS place, x.a || ',' || m.c AS x, x.f || ',' || m.h AS y, x.re AS ur, x.im AS ui FROM m JOIN ({tensor_sql('FL')}) x ON x.d = m.e AND x.i = m.i AND x.j = (m.j + 1) % {CELL}",
    "j", "i", _FORM, 12))
def bond_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the bond's leading vectors (a linear solve a column): the gradient by the right environments of |c S c / c c| in row 0, in millionths."""
    fl, fr, m = _lineitem(spark, sf_dir, "FL", "FR", "M")
    tape = Tape()
    left, right = tape.leaf(fl), tape.leaf(fr)
    c = tape.bonds(random_like(m.df, {"a": 4, "b": 4}, 1, cells.KEYS), left, m, right, CELL, CELL)
    (g,) = tape.gradient(_overlap(tape, c, _FORM, m.df, 12, "i"), [right])
    return _gradient_by(g)


@query(_vector_gradient_sql(
    product([("FL", "adf"), ("M", "dgeb"), ("FR", "ceh")], "abc", "fgh"), _BULK, "dgeb",
    f"SELECT m.p, side, part, m.i AS place, x.a || ',' || m.b || ',' || y.c AS x, x.f || ',' || m.g || ',' || y.h AS y, {_UNIT} FROM m JOIN ({tensor_sql('FL')}) x ON x.d = m.d AND x.i = m.i AND x.j = m.j JOIN ({tensor_sql('FR')}) y ON y.e = m.e AND y.i = m.i AND y.j = m.j",
    "j", "i", _SIX, 13))
def centre_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the centre's leading vectors, by the bulk tensor."""
    fl, fr, m, au = _lineitem(spark, sf_dir, "FL", "FR", "M", "AU")
    tape = Tape()
    bulk = tape.leaf(m)
    ac = tape.centres(au, tape.leaf(fl), bulk, tape.leaf(fr), CELL, CELL)
    (g,) = tape.gradient(_overlap(tape, ac, _SIX, m.df, 13, "i"), [bulk])
    return _gradient_by(g)


_LEFT_FORM = {"a": 4, "d": 2, "f": 4, "t": 4, "u": 2, "v": 4}


@query(_vector_gradient_sql(
    product([("AU", "abc"), ("M", "dgeb"), ("AD", "fgh", 1, 0)], "adf", "ceh"), _BULK, "dgeb",
    f"SELECT m.p, side, part, m.j AS place, x.a || ',' || m.d || ',' || y.f AS x, x.c || ',' || m.e || ',' || y.h AS y, {_UNIT} FROM m JOIN ({tensor_sql('AU')}) x ON x.b = m.b AND x.i = m.i AND x.j = m.j JOIN ({tensor_sql('AD')}) y ON y.g = m.g AND y.i = (m.i + 1) % {CELL} AND y.j = m.j",
    "i", "j", _LEFT_FORM, 14))
def left_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the left environments of every row, by the bulk tensor."""
    au, ad, m = _lineitem(spark, sf_dir, "AU", "AD", "M")
    tape = Tape()
    bulk = tape.leaf(m)
    env = tape.environment(tape.leaf(au), bulk, tape.leaf(ad), CELL, CELL)
    (g,) = tape.gradient(_overlap(tape, env, _LEFT_FORM, m.df, 14, "j"), [bulk])
    return _gradient_by(g)


def _multiplet_sql() -> str:
    steps, last = leading_value("b", product([("FL", "acd", 0, 1), ("FR", "bce")], "ab", "de"), "j", "i")
    angle = f"(atan2(im, re) + 2 * pi() * k) / {CELL}"
    return f"""WITH {', '.join(steps)}, r AS (SELECT s, exp(ln(sqrt(re * re + im * im)) / {CELL}) / 1e4 AS u, {angle} AS angle FROM {last}, (SELECT unnest(range({CELL})) AS k))
        SELECT s AS j, (row_number() OVER (PARTITION BY s ORDER BY cos(angle) DESC, sin(angle) DESC) - 1)::INT AS k, round(u * cos(angle), 5) AS re, round(u * sin(angle), 5) AS im FROM r"""


@query(_multiplet_sql())
def degenerate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three eigenvalues of one modulus that the bond's map on all rows at once has in every column, by subspace iteration on tables."""
    c, fl, fr = lineitem_tensors(spark, sf_dir, ("C", "FL", "FR"))
    fl, fr = (t._with(cut(t.df)) for t in (fl, fr))
    # the row belongs to the vector: its index, not a key
    guesses = [_rowed(random_like(c.df, {"a": 4, "b": 4}, seed)) for seed in range(6)]

    def apply(x: Tensor) -> Tensor:
        y = Tensor(x.df, ("a", "b"), c.dims, ("i", *x.batch))
        y = maps.bond_map(y, fl, fr, CELL, CELL)
        return Tensor(y.df, ("d", "e", "i"), {}, tuple(k for k in y.batch if k != "i"))

    values, _ = krylov.leading(apply, guesses, CELL, ("j",), tol=1e-8, inner=CELL)
    return values.select("j", "k", F.round(F.col("vr") / 1e4, 5).alias("re"), F.round(F.col("vi") / 1e4, 5).alias("im"))


def _rowed(x: Tensor) -> Tensor:
    return Tensor(x.df, (*x.index, "i"), {**x.dims, "i": CELL}, tuple(k for k in x.batch if k != "i"))
