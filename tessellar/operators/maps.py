"""The transfer maps of a unit cell and their derivatives.

All take tensors with indices as drawn: the upper state ``a b c``, the bulk
``d g e b`` (left, down, right, up), the lower state ``f g h``, the left and
right environments ``a d f`` and ``c e h``, the bond ``a b``. The lower state
stands one row further down; ``below`` brings it to the row it acts on.
"""

from __future__ import annotations

from .contract import contract
from .tensor import Tensor


def below(lower: Tensor, rows: int) -> Tensor:
    return lower.shift("i", -1, rows)


def left_map(env: Tensor, upper: Tensor, bulk: Tensor, lower: Tensor, columns: int) -> Tensor:
    """One column further right."""
    return contract((((env, upper), bulk), lower), "ceh").shift("j", 1, columns)


def right_map(env: Tensor, upper: Tensor, bulk: Tensor, lower: Tensor, columns: int) -> Tensor:
    return contract((((env, upper), bulk), lower), "adf").shift("j", -1, columns)


def centre_map(centre: Tensor, left: Tensor, bulk: Tensor, right: Tensor, rows: int) -> Tensor:
    """One row further down."""
    return contract((((left, centre), bulk), right), "fgh").shift("i", 1, rows)


def bond_map(bond: Tensor, left: Tensor, right: Tensor, rows: int, columns: int) -> Tensor:
    """The left environment is that of the next column."""
    x = left.rename("a", "c", "d").shift("j", -1, columns)
    return contract(((x, bond), right.rename("b", "c", "e")), "de").shift("i", 1, rows)


def density_step(rho: Tensor, state: Tensor, columns: int) -> Tensor:
    """A' rho A of each column, for the next one."""
    tree = ((rho.rename("d", "c"), state.rename("c", "s", "b")), state.conj().rename("d", "s", "a"))
    return contract(tree, "ab").shift("j", 1, columns)


def bond_of(left: Tensor, right: Tensor, columns: int) -> Tensor:
    """L of a column times R of the next."""
    return contract((left.rename("a", "b"), right.rename("b", "c").shift("j", -1, columns)), "ac")


def absorb(state: Tensor, bond: Tensor) -> Tensor:
    return contract((state.rename("a", "s", "c"), bond.rename("c", "b")), "asb")


def project(centre: Tensor, right: Tensor) -> Tensor:
    """What of the centre lies in the span of the right-canonical state."""
    return contract(((centre.rename("a", "p", "c"), right.conj().rename("d", "p", "c")), right.rename("d", "s", "b")), "asb")


def power_of_centre_map(centre: Tensor, left: Tensor, bulk: Tensor, right: Tensor, rows: int) -> Tensor:
    """Down through all rows, back to where it began."""
    for _ in range(rows):
        centre = centre_map(centre, left, bulk, right, rows).rename("a", "b", "c")
    return centre


# Derivatives of the environments' equations by each factor; the cotangent stands for the missing environment.


def d_upper(left: Tensor, lower: Tensor, bulk: Tensor, right: Tensor) -> Tensor:
    return contract((((left, lower), bulk), right), "abc").minus_conj()


def d_lower(left: Tensor, upper: Tensor, bulk: Tensor, right: Tensor) -> Tensor:
    return contract((((left, upper), bulk), right), "fgh").minus_conj()


def d_bulk(left: Tensor, upper: Tensor, lower: Tensor, right: Tensor) -> Tensor:
    return contract(((left, upper), (lower, right)), "dgeb").minus_conj()


def d_left(upper: Tensor, right: Tensor, bulk: Tensor, lower: Tensor) -> Tensor:
    return contract((((upper, right), bulk), lower), "adf").minus_conj()


def d_bulk_centre(upper: Tensor, left: Tensor, right: Tensor, lower: Tensor) -> Tensor:
    return contract(((upper, left), (right, lower)), "dgeb").minus_conj()


def d_right(upper: Tensor, left: Tensor, bulk: Tensor, lower: Tensor) -> Tensor:
    return contract((((upper, left), bulk), lower), "ceh").minus_conj()


def d_left_bond(bond: Tensor, right: Tensor, other: Tensor) -> Tensor:
    return contract(((bond, right.rename("b", "c", "e")), other.rename("d", "e")), "acd").minus_conj()


def d_right_bond(bond: Tensor, left: Tensor, other: Tensor) -> Tensor:
    return contract(((bond, left.rename("a", "c", "d")), other.rename("d", "e")), "bce").minus_conj()


def left_adjoint(env: Tensor, upper: Tensor, bulk: Tensor, lower: Tensor, columns: int) -> Tensor:
    """Adjoint of ``left_map``: the shift comes first."""
    return contract((((env.shift("j", -1, columns), upper), bulk), lower), "adf")


def right_adjoint(env: Tensor, upper: Tensor, bulk: Tensor, lower: Tensor, columns: int) -> Tensor:
    return contract((((env.shift("j", 1, columns), upper), bulk), lower), "ceh")


def centre_adjoint(centre: Tensor, left: Tensor, bulk: Tensor, right: Tensor, rows: int) -> Tensor:
    return contract((((left, centre.rename("f", "g", "h").shift("i", -1, rows)), bulk), right), "abc")


def bond_adjoint(bond: Tensor, left: Tensor, right: Tensor, rows: int, columns: int) -> Tensor:
    x = left.rename("a", "c", "d").shift("j", -1, columns)
    return contract(((x, bond.rename("d", "e").shift("i", -1, rows)), right.rename("b", "c", "e")), "ab")
