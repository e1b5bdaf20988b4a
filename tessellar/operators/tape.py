"""Gradients of compositions: a tape of operations, run backwards.

Every operation on the tape keeps its result (a checkpoint, so that going
backwards doesn't repeat what came before) and says what a cotangent of its
result gives its operands. A contraction's tree gives one entry a pair: for
z = sum x y the cotangent of x is the sum of that of z with conj(y), a
contraction of the same kind over the same keys. Environments, factors and norms
are entries with rules of their own.

Cotangents are those of ``num_grad``: for a real loss, d loss = re sum(conj(g) dz).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import adjoint, cells, environments, maps
from .contract import pair
from .tensor import Tensor


@dataclass(frozen=True)
class Node:
    """A result on a tape."""

    tape: Tape
    number: int
    value: Tensor


def _zero(t: Tensor) -> Tensor:
    return t._with(t.df.withColumns({"re": F.lit(0.0), "im": F.lit(0.0)}))


def _by_batch(t: Tensor, numbers, combine, batch: tuple[str, ...]) -> Tensor:
    """Entries with ``_u, _v`` of their batch (missing: 0) as ``combine`` says."""
    rows = t.df.join(numbers, [k for k in batch if k in t.batch], "left")
    u, v = (F.coalesce(F.col(k), F.lit(0.0)) for k in ("_u", "_v"))
    re, im = combine(F.col("re"), F.col("im"), u, v)
    return t._with(rows.select(*t.keys, re.alias("re"), im.alias("im")))


def _pairs(t: Tensor):
    """A scalar's values as ``_u, _v``."""
    return t.df.select(*t.batch, F.col("re").alias("_u"), F.col("im").alias("_v"))


def _spread(g: Tensor, like: Tensor) -> Tensor:
    """A cotangent summed to the batch of ``like``, and repeated along indices that only ``like`` has (its sum runs over them)."""
    df = g.df
    for k in like.index:
        if k not in g.keys:
            df = df.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(like.dims[k] - 1))))
    sums = [F.sum("re").alias("re"), F.sum("im").alias("im")]
    return Tensor(df.groupBy(*like.keys).agg(*sums), like.index, like.dims, like.batch)


@dataclass
class Tape:
    """Operations in the order they were done. ``keep`` says how a result is held; the default is a checkpoint."""

    keep: Callable = field(default=lambda t: t._with(cut(t.df)))
    nodes: list[tuple] = field(default_factory=list)

    def _add(self, value: Tensor, parents: tuple[Node, ...] = (), pull: Callable | None = None) -> Node:
        node = Node(self, len(self.nodes), self.keep(value))
        self.nodes.append((node, parents, pull))
        return node

    def leaf(self, value: Tensor) -> Node:
        return self._add(value)

    # entry by entry

    def rename(self, x: Node, *names: str) -> Node:
        return self._add(x.value.rename(*names), (x,), lambda g: [g.rename(*x.value.index)])

    def shift(self, x: Node, axis: str, by: int, size: int) -> Node:
        return self._add(x.value.shift(axis, by, size), (x,), lambda g: [g.shift(axis, -by, size)])

    def fix(self, x: Node, axis: str, value: int) -> Node:
        """A slice; entries outside it get no cotangent."""
        return self._add(x.value.fix(axis, value), (x,), lambda g: [g])

    def conj(self, x: Node) -> Node:
        return self._add(x.value.conj(), (x,), lambda g: [g.conj()])

    def scale(self, x: Node, re: float, im: float = 0.0) -> Node:
        return self._add(x.value.scale(re, im), (x,), lambda g: [g.scale(re, -im)])

    def add(self, x: Node, y: Node) -> Node:
        return self._add(x.value.add(y.value), (x, y), lambda g: [g, g])

    # contractions

    def pair(self, x: Node, y: Node, out: tuple[str, ...]) -> Node:
        def pull(g: Tensor) -> list[Tensor]:
            gx = pair(g, y.value.conj(), tuple(k for k in x.value.index if k in g.index or k in y.value.index))
            gy = pair(g, x.value.conj(), tuple(k for k in y.value.index if k in g.index or k in x.value.index))
            return [_spread(gx, x.value), _spread(gy, y.value)]

        return self._add(pair(x.value, y.value, out), (x, y), pull)

    def contract(self, tree, out: str | tuple[str, ...] = ()) -> Node:
        """A nested pair of nodes, as ``contract``: one entry of the tape for each pair."""
        out = tuple(out)

        def indices(node) -> set[str]:
            return set(node.value.index) if isinstance(node, Node) else indices(node[0]) | indices(node[1])

        def go(node, outside: set[str], final: tuple[str, ...] | None) -> Node:
            if isinstance(node, Node):
                return node
            a, b = node
            x, y = go(a, outside | indices(b), None), go(b, outside | indices(a), None)
            both = dict.fromkeys(x.value.index + y.value.index)
            return self.pair(x, y, final if final is not None else tuple(k for k in both if k in outside))

        return go(tree, set(out), out)

    # scalars and norms

    def divide(self, x: Node, y: Node) -> Node:
        """The quotient of two scalars of each cell."""
        over = lambda a, b, u, v: (F.try_divide(a * u + b * v, u * u + v * v), F.try_divide(b * u - a * v, u * u + v * v))
        q = self.keep(_by_batch(x.value, _pairs(y.value), over, y.value.batch))

        def pull(g: Tensor) -> list[Tensor]:
            gx = _by_batch(g, _pairs(y.value.conj()), over, y.value.batch)
            minus = lambda a, b, u, v: (b * v - a * u, F.lit(0.0) - a * v - b * u)
            gy = _by_batch(gx, _pairs(q.conj()), minus, q.batch)
            return [gx, _spread(gy, y.value)]

        return self._add(q, (x, y), pull)

    def modulus(self, x: Node) -> Node:
        """|x| of every entry; its cotangent at 0 is 0."""
        size = x.value._with(x.value.df.select(*x.value.keys, F.hypot("re", "im").alias("re"), F.lit(0.0).alias("im")))
        phase = x.value.phase()

        def pull(g: Tensor) -> list[Tensor]:
            r = g.df.select(*g.keys, F.col("re").alias("_u"))
            zero = x.value.df.where((F.col("re") != 0) | (F.col("im") != 0)).select(*x.value.keys)
            rows = phase.df.join(zero, list(x.value.keys)).join(r, list(x.value.keys))
            return [x.value._with(rows.select(*x.value.keys, (F.col("re") * F.col("_u")).alias("re"), (F.col("im") * F.col("_u")).alias("im")))]

        return self._add(size, (x,), pull)

    def total(self, x: Node, batch: tuple[str, ...] = ("problem",)) -> Node:
        """The sum over all entries of each of ``batch``."""
        sums = [F.sum("re").alias("re"), F.sum("im").alias("im")]
        df = x.value.df.groupBy(*batch).agg(*sums) if batch else x.value.df.agg(*sums)
        pull = lambda g: [_by_batch(_zero(x.value), _pairs(g), lambda a, b, u, v: (a + u, b + v), batch)]
        return self._add(Tensor(df, (), {}, batch), (x,), pull)

    def norm(self, x: Node) -> Node:
        """The Frobenius norm of each cell; where it is 0 so is its cotangent."""
        squares = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
        norms = x.value.df.groupBy(*x.value.batch).agg(F.sqrt(squares).alias("re"), F.lit(0.0).alias("im"))
        value = self.keep(Tensor(norms, (), {}, x.value.batch))
        return self._add(value, (x,), lambda g: [norm_cotangent(x.value, value, g)])

    def normalized(self, x: Node) -> Node:
        """Over the norm of each cell."""
        z = self.keep(x.value.normalized())
        norms = x.value.norms().select(*x.value.batch, F.col("norm").alias("_u"), F.lit(0.0).alias("_v"))

        def pull(g: Tensor) -> list[Tensor]:
            both = z.df.join(g.df.select(*g.keys, F.col("re").alias("_a"), F.col("im").alias("_b")), list(z.keys))
            along = both.groupBy(*z.batch).agg(F.sum(F.col("re") * F.col("_a") + F.col("im") * F.col("_b")).alias("_u"), F.lit(0.0).alias("_v"))
            part = _by_batch(z, along, lambda a, b, u, v: (F.lit(0.0) - a * u, F.lit(0.0) - b * u), z.batch)
            return [_by_batch(g.add(part), norms, lambda a, b, u, v: (F.try_divide(a, u), F.try_divide(b, u)), z.batch)]

        return self._add(z, (x,), pull)

    # grouped maps

    def factors(self, x: Node, column: str, other: str = "z", left: bool = True) -> tuple[Node, Node]:
        """Q and R of each cell's matrix, ``column`` against the other indices (for ``left=False`` L and Q, ``column`` being the row)."""
        t = x.value
        rest = tuple(k for k in t.index if k != column)
        wide = tuple(t.dims[k] for k in rest)
        n = t.dims[column]
        order = (*rest, column) if left else (column, *rest)
        tall = 1
        for d in wide:
            tall *= d
        matrix = lambda v, name: adjoint.reshaped(cells.pack(Tensor(v.df, order, v.dims, v.batch), name), (tall, n) if left else (n, tall))
        square = lambda v, name: cells.pack(Tensor(v.df, (other, column) if left else (column, other), {other: n, column: n}, v.batch), name)
        whole = lambda rows, name: cells.unpack(rows, name, order, (*wide, n) if left else (n, *wide))
        named = lambda v: v.rename(*(other if k == column else k for k in v.index))
        a = cut(matrix(t, "A"))
        found = cut(adjoint.factors(a, left))
        back = lambda v: v.rename(*(column if k == other else k for k in v.index))
        joint = len(self.nodes)
        both = Node(self, joint, t)
        self.nodes.append((both, (x,), None))
        q = self._add(named(whole(found, "Q")), (both,))
        small = "R" if left else "L"
        square_index = (other, column) if left else (column, other)
        r = self._add(cells.unpack(found, small, square_index, (n, n)), (both,))

        def pull(gq: Tensor | None, gr: Tensor | None) -> list[Tensor]:
            parts = a
            parts = parts.unionByName(matrix(back(gq if gq is not None else _zero(q.value)), "DQ"))
            parts = parts.unionByName(square(gr if gr is not None else _zero(r.value), "D" + small))
            out = adjoint.factor_cotangents(parts, left)
            return [whole(out, "DA")]

        self.nodes[joint] = (both, (x,), (pull, q.number, r.number))
        return q, r

    def centres(self, guess: Tensor, left: Node, bulk: Node, right: Node, rows: int, columns: int) -> Node:
        """The leading vector of the centre's map of each column (environments ``adf``, ``ceh``, bulk ``dgeb``, centre ``abc``).

        The loss mustn't depend on its norm and phase.
        """
        fixed, found = self._vertical(guess, None, left, bulk, right, columns)
        dims = tuple(guess.dims[k] for k in guess.index)
        ac = self.keep(cells.unpack(found, "AC", "abc", dims))

        def pull(g: Tensor) -> list[Tensor]:
            given = found.where(F.col("name").isin("AC", "VA")).unionByName(cells.pack(g, "DF"))
            x = cells.unpack(adjoint.centre_cotangents(fixed.unionByName(given)), "X", "fgh", dims)
            # the next row's, conjugated, stands for the lower state
            low = self.keep(x.conj().shift("i", -1, rows))
            return [maps.d_left(ac, right.value, bulk.value, low), maps.d_bulk_centre(ac, left.value, right.value, low), maps.d_right(ac, left.value, bulk.value, low)]

        return self._add(ac, (left, bulk, right), pull)

    def bonds(self, guess: Tensor, left: Node, bulk: Tensor, right: Node, rows: int, columns: int) -> Node:
        """The leading vector of the bond's map of each column; ``bulk`` only says what cells there are."""
        fixed, found = self._vertical(None, guess, left, self.leaf(bulk), right, columns)
        dims = tuple(guess.dims[k] for k in guess.index)
        c = self.keep(cells.unpack(found, "C", "ab", dims))

        def pull(g: Tensor) -> list[Tensor]:
            given = found.where(F.col("name").isin("C", "VC")).unionByName(cells.pack(g, "DF"))
            x = cells.unpack(adjoint.bond_cotangents(fixed.unionByName(given), columns), "X", "de", dims)
            low = self.keep(x.conj().shift("i", -1, rows))
            gl = maps.d_left_bond(c, right.value, low).shift("j", 1, columns)
            return [gl.rename(*left.value.index), maps.d_right_bond(c, left.value.shift("j", -1, columns), low).rename(*right.value.index)]

        return self._add(c, (left, right), pull)

    def _vertical(self, centre: Tensor | None, bond: Tensor | None, left: Node, bulk: Node, right: Node, columns: int):
        """What the columns' grouped maps need, and what they find; a guess that isn't given is one of ones."""
        fixed = cells.pack(left.value, "FL").unionByName(cells.pack(bulk.value, "M")).unionByName(cells.pack(right.value, "FR"))
        fixed = cut(fixed)
        n = [(left.value.dims[left.value.index[0]], "a"), (bulk.value.dims[bulk.value.index[3]], "b"), (right.value.dims[right.value.index[0]], "c")]
        if centre is None:
            centre = _ones(bulk.value, {k: d for d, k in n})
        if bond is None:
            bond = _ones(bulk.value, {"a": n[0][0], "b": n[2][0]})
        return fixed, cut(environments.centres(fixed.unionByName(cells.pack(centre, "AC")).unionByName(cells.pack(bond, "C")), columns))

    def environment(self, state: Node, bulk: Node, lower: Node, rows: int, columns: int, left: bool = True) -> Node:
        """The leading vector of the left or right map of each row: ``state`` (``abc``) above, ``lower`` (``fgh``, taken as it is, kept a row further down) below.

        The loss mustn't depend on its norm and phase.
        """
        side, edge, value = ("AL", "FL", "VL") if left else ("AR", "FR", "VR")
        twin = "AR" if left else "AL"
        up, m, low = state.value, bulk.value, lower.value
        packed = lambda t, *names: [cells.pack(t, name) for name in names]
        parts = packed(up, side, twin) + packed(m, "M")
        upper = cut(parts[0].unionByName(parts[1]).unionByName(parts[2]))
        below = packed(low, side, twin)
        under = cut(below[0].unionByName(below[1]))
        found = cut(environments.environments(upper, under, rows=rows, left=left, right=not left))
        index = "adf" if left else "ceh"
        dims = (up.dims[up.index[0 if left else 2]], m.dims[m.index[0 if left else 2]], low.dims[low.index[0 if left else 2]])
        env = self.keep(cells.unpack(found, edge, index, dims))

        def pull(g: Tensor) -> list[Tensor]:
            given = found.where(F.col("name").isin(edge, value)).unionByName(cells.pack(g, "DF"))
            solve = adjoint.left_cotangents if left else adjoint.right_cotangents
            x = cells.unpack(solve(upper, under, given, rows), "X", "ceh" if left else "adf", dims)
            far = self.keep(x.conj().shift("j", -1 if left else 1, columns))
            one, two = (env, far) if left else (far, env)
            under_row = maps.below(low, rows)
            return [maps.d_upper(one, under_row, m, two), maps.d_bulk(one, up, under_row, two), maps.d_lower(one, up, m, two).shift("i", 1, rows)]

        return self._add(env, (state, bulk, lower), pull)

    def isometries(self, centre: Node, bond: Node, columns: int) -> tuple[Node, Node]:
        """The left and right isometries nearest to ``centre`` (``abc``) and ``bond`` (``ab``) of each cell."""
        ac, c = self.normalized(centre), self.normalized(bond)
        q, _ = self.factors(ac, "c", "y")
        p, _ = self.factors(c, "b", "y")
        left = self.contract((q, self.conj(self.rename(p, "c", "y"))), "abc")
        before = self.shift(c, "j", 1, columns)
        k, _ = self.factors(ac, "a", "y", left=False)
        w, _ = self.factors(before, "a", "y", left=False)
        right = self.contract((self.conj(self.rename(w, "y", "a")), k), "abc")
        return left, right

    # backwards

    def gradient(self, of: Node, by: list[Node], seed: Tensor | None = None) -> list[Tensor]:
        """The cotangents of ``by``, from ``seed`` at ``of`` (default: 1 everywhere, the gradient of the sum of its real parts)."""
        if seed is None:
            seed = of.value._with(of.value.df.select(*of.value.keys, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")))
        found: dict[int, Tensor] = {of.number: seed}
        needed = self._reaching(by)
        for number in range(of.number, -1, -1):
            _, parents, pull = self.nodes[number]
            if isinstance(pull, tuple):
                run, q, r = pull
                if q not in found and r not in found:
                    continue
                parts = run(found.get(q), found.get(r))
            elif pull is not None and number in found:
                parts = pull(found[number])
            else:
                continue
            for parent, part in zip(parents, parts, strict=True):
                if parent.number not in needed:
                    continue
                part = self.keep(Tensor(part.df.select(*parent.value.keys, "re", "im"), parent.value.index, parent.value.dims, parent.value.batch))
                found[parent.number] = self.keep(found[parent.number].add(part)) if parent.number in found else part
        return [found.get(node.number, _zero(node.value)) for node in by]

    def _reaching(self, by: list[Node]) -> set[int]:
        """Numbers of the nodes that depend on one of ``by``."""
        out = {node.number for node in by}
        for number, (_, parents, _) in enumerate(self.nodes):
            if any(p.number in out for p in parents):
                out.add(number)
        return out


def _ones(like: Tensor, dims: dict[str, int]) -> Tensor:
    """A tensor of ones for each cell of ``like``."""
    df = like.df.select(*like.batch).distinct()
    for k, n in dims.items():
        df = df.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return Tensor(df.select(*dims, *like.batch, F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), tuple(dims), dict(dims), like.batch)


def norm_cotangent(x: Tensor, norms: Tensor, g: Tensor) -> Tensor:
    """g x / (norm + the least positive single): 0 where the norm is."""
    at = norms.df.join(g.df.select(*g.batch, F.col("re").alias("_g")), list(norms.batch))
    factor = at.select(*norms.batch, (F.col("_g") / (F.col("re") + F.lit(2.0**-149))).alias("_u"), F.lit(0.0).alias("_v"))
    return _by_batch(x, factor, lambda a, b, u, v: (a * u, b * u), norms.batch)
