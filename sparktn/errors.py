"""Errors that callers can meet; all are ValueErrors."""


class TensorError(ValueError):
    """A shape, an index or a permutation doesn't fit."""


class ContractionError(TensorError):
    """A notation or pair of axes can't be contracted."""


class BlockError(TensorError):
    """Legs, sectors or flux of a block-sparse tensor don't fit."""


class FactorizationError(TensorError):
    """A split, truncation or operand of a factorization isn't allowed."""


class ContainerError(TensorError):
    """A stored object's manifest, columns or elements aren't what they should be."""
