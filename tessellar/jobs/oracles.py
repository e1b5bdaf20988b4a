"""SQL text for queries on tensors gathered from ``lineitem``."""

from __future__ import annotations

from ..sources.tables import CELL, LINEITEM


def tensor_sql(name: str) -> str:
    keys = ", ".join(f"({c} % {n})::INT AS {k}" for k, (c, n) in LINEITEM[name].items())
    return f"""SELECT {keys}, (l_quantity::INT % {CELL})::INT AS i, (month(l_shipdate) % {CELL})::INT AS j, count(*)::DOUBLE AS re,
        sum(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END)::DOUBLE AS im FROM lineitem GROUP BY ALL"""


def over(name: str, columns: str, rest: str = "", source: str = "t") -> str:
    return f"WITH t AS ({tensor_sql(name)}) SELECT {columns} FROM {source} {rest}"


def chain(factors: list[tuple], out: str, i: int = 0, j: int = 0, minus_conj: bool = False) -> str:
    """Factors joined from the left, summed after each: (tensor, labels, row offset, column offset, conjugated).

    The factor stands ``offset`` beyond the result's cell, before the result
    moves by ``i`` rows and ``j`` columns. ``mirror`` as row offset counts rows from the end.
    For a tensor's name there may stand SQL and its indices.
    """
    ctes, known = [], ""
    for k, (name, labels, *rest) in enumerate(factors):
        di, dj, conj = (*rest, *(0, 0, False)[len(rest) :])
        row = f"{CELL - 1} - i" if di == "mirror" else f"(i + {-di % CELL}) % {CELL}"
        source, index = (tensor_sql(name), LINEITEM[name]) if isinstance(name, str) else name
        cols = ", ".join(f"{own} AS {label}" for own, label in zip(index, labels, strict=True))
        ctes.append(f"f{k} AS (SELECT {cols}, ({row})::INT AS i, ((j + {-dj % CELL}) % {CELL})::INT AS j, re, {'0 - im' if conj else 'im'} AS im FROM ({source}))")
        if not k:
            ctes.append("p0 AS (SELECT * FROM f0)")
            known = labels
            continue
        later = "".join(x[1] for x in factors[k + 1 :]) + out
        keep = [c for c in dict.fromkeys(known + labels) if c in later]
        shared = [c for c in known if c in labels]
        on = " AND ".join(f"x.{c} = y.{c}" for c in [*shared, "i", "j"])
        sel = ", ".join(f"{'x' if c in known else 'y'}.{c}" for c in [*keep]) + (", " if keep else "")
        ctes.append(f"p{k} AS (SELECT {sel}x.i, x.j, sum(x.re * y.re - x.im * y.im) AS re, sum(x.re * y.im + x.im * y.re) AS im FROM p{k - 1} x JOIN f{k} y ON {on} GROUP BY {sel}x.i, x.j)")
        known = "".join(keep)
    sel = "".join(f"{c}, " for c in out)
    re, im = ("0 - re", "im") if minus_conj else ("re", "im")
    return f"WITH {', '.join(ctes)} SELECT {sel}((i + {i % CELL}) % {CELL})::INT AS i, ((j + {j % CELL}) % {CELL})::INT AS j, {re} AS re, {im} AS im FROM p{len(factors) - 1}"


def cholesky(name: str, column: str, conj: bool = False) -> tuple[str, str]:
    """A WITH clause and the name of its last part: every row of a matrix with its columns orthonormalised one by one (``q<k>r, q<k>i``) and R's entries (``r<k><l>r, r<k><l>i``)."""
    rows = [k for k in LINEITEM[name] if k != column]
    n = LINEITEM[name][column][1]
    keys = ", ".join(rows)
    over = "OVER (PARTITION BY i, j)"
    sign = "0 - " if conj else ""
    picks = ", ".join(f"{sign if p == 'im' else ''}sum(CASE WHEN {column} = {k} THEN {p} ELSE 0 END) AS x{k}{p[0]}" for k in range(n) for p in ("re", "im"))
    ctes = [f"t AS ({tensor_sql(name)})", f"s0 AS (SELECT {keys}, i, j, {picks} FROM t GROUP BY {keys}, i, j)"]
    for k in range(n):
        ctes.append(f"d{k} AS (SELECT *, sqrt(sum(x{k}r * x{k}r + x{k}i * x{k}i) {over}) AS r{k}{k}r FROM s{k})")
        ctes.append(f"e{k} AS (SELECT *, x{k}r / r{k}{k}r AS q{k}r, x{k}i / r{k}{k}r AS q{k}i FROM d{k})")
        sums = "".join(f", sum(q{k}r * x{m}r + q{k}i * x{m}i) {over} AS r{k}{m}r, sum(q{k}r * x{m}i - q{k}i * x{m}r) {over} AS r{k}{m}i" for m in range(k + 1, n))
        ctes.append(f"f{k} AS (SELECT *{sums} FROM e{k})")
        less = ", ".join(f"x{m}r - (q{k}r * r{k}{m}r - q{k}i * r{k}{m}i) AS x{m}r, x{m}i - (q{k}r * r{k}{m}i + q{k}i * r{k}{m}r) AS x{m}i" for m in range(k + 1, n))
        ctes.append(f"s{k + 1} AS (SELECT * REPLACE ({less}) FROM f{k})" if less else f"s{k + 1} AS (SELECT * FROM f{k})")
    return "WITH " + ", ".join(ctes), f"s{n}"


def product(factors: list[tuple], x: str, y: str) -> str:
    """``i, j, x, y, re, im``: factors contracted as in ``chain``, as matrices from the indices ``x`` to the indices ``y``."""
    number = lambda t, labels: " || ',' || ".join(f"{t}{k}" for k in labels)
    return f"SELECT i, j, {number('', x)} AS x, {number('', y)} AS y, re, im FROM ({chain(factors, x + y)})"


def leading_value(name: str, matrices: str, slot: str, order: str, squarings: int = 5, around: int = CELL) -> tuple[list[str], str]:
    """CTEs and the last one's name: of each ``slot`` the leading eigenvalue (``re, im``) of the product of all matrices ``around`` ``order``.

    From traces: tr(P^(n + 1)) / tr(P^n) for an n of 2 to the ``squarings``, each power over its norm.
    """
    times = lambda one, two, i, j: f"SELECT u.s, u.x, v.y, sum(u.re * v.re - u.im * v.im) AS re, sum(u.re * v.im + u.im * v.re) AS im FROM {one} u JOIN {two} v ON u.y = v.x AND u.s = v.s {i} {j} GROUP BY ALL"
    scaled = lambda inner: f"SELECT s, x, y, re / sqrt(sum(re * re + im * im) OVER (PARTITION BY s)) AS re, im / sqrt(sum(re * re + im * im) OVER (PARTITION BY s)) AS im FROM ({inner})"
    ctes = [f"{name}m AS MATERIALIZED ({matrices})"]
    ctes += [f"{name}f{k} AS (SELECT {slot} AS s, x, y, re, im FROM {name}m WHERE {order} = {k})" for k in range(around)]
    last = f"{name}f0"
    for k in range(1, around):
        ctes.append(f"{name}p{k} AS MATERIALIZED ({times(last, f'{name}f{k}', '', '')})")
        last = f"{name}p{k}"
    ctes.append(f"{name}q0 AS MATERIALIZED ({scaled(f'SELECT * FROM {last}')})")
    for k in range(squarings):
        ctes.append(f"{name}q{k + 1} AS MATERIALIZED ({scaled(times(f'{name}q{k}', f'{name}q{k}', '', ''))})")
    q = f"{name}q{squarings}"
    ctes.append(f"{name}n AS (SELECT u.s, sum(u.re * v.re - u.im * v.im) AS re, sum(u.re * v.im + u.im * v.re) AS im FROM {q} u JOIN {last} v ON u.y = v.x AND u.x = v.y AND u.s = v.s GROUP BY u.s)")
    ctes.append(f"{name}d AS (SELECT s, sum(re) AS re, sum(im) AS im FROM {q} WHERE x = y GROUP BY s)")
    size = "(d.re * d.re + d.im * d.im)"
    ctes.append(f"{name}v AS (SELECT n.s, (n.re * d.re + n.im * d.im) / {size} AS re, (n.im * d.re - n.re * d.im) / {size} AS im FROM {name}n n JOIN {name}d d USING (s))")
    return ctes, f"{name}v"
