"""Shape of the codec and limits of an index."""

from __future__ import annotations

from dataclasses import dataclass

#: Limits of the index format (fixed values).
MAX_SEGMENTS = 4096
SEGMENT_ROWS = 65_536
MAX_ROWS = (1 << 48) - 1
MAX_TRAINING = 32_768
LEAST_TRAINING = 256
MAX_NORM = 65_504.0
LEAST_NORM = 1e-12
FRACTION_BITS = 24
ONE = 1 << FRACTION_BITS


@dataclass(frozen=True)
class CodecSpec:
    """Rotation of ``rounds`` rounds over blocks of ``block`` coordinates, 16 centers per coordinate, and a product
    quantiser of ``centroids`` centroids over sub-vectors of ``sub`` coordinates for what the centers leave."""

    dim: int
    block: int
    rounds: int = 2
    centers: int = 16
    sub: int = 8
    centroids: int = 256

    def __post_init__(self):
        if self.block & (self.block - 1) or self.dim % self.block or self.dim % self.sub or self.dim % 2:
            raise ValueError("block must be a power of 2, and block and sub must divide an even dim")
        if not 2 <= self.centers <= 16 or not 1 <= self.centroids <= 256:
            raise ValueError("at most 16 centers and 256 centroids")

    @property
    def subs(self) -> int:
        return self.dim // self.sub

    @property
    def stages(self) -> int:
        return self.block.bit_length() - 1


SPEC_768 = CodecSpec(768, 128)
SPEC_64 = CodecSpec(64, 32, centroids=64)


def default_validation(rows: int) -> int:
    return min(rows // 4, 4096)
