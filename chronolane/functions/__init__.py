"""Column-level building blocks."""

from chronolane.functions.columns import (  # noqa: F401
    bit_width,
    fold_text,
    finite,
    no_data,
    or_no_data,
    poly_bucket,
    window_start,
    zigzag_decode,
    zigzag_encode,
)
