"""Parameters of the plans, with the usual defaults, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

#: SAM flag bits.
PAIRED, PROPER_PAIR, UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE = 1, 2, 4, 256, 512, 1024
#: Default exclusions with UMIs, and without (where duplicates go too).
EXCLUDE_UMI = UNMAPPED | SECONDARY | QC_FAIL
EXCLUDE_READS = EXCLUDE_UMI | DUPLICATE


def resolve_umi_tag(tag: str | None, with_barcodes: bool) -> str | None:
    """AUTO is UB with barcodes and none without; the word None means none."""
    if tag is None or tag == "None":
        return None
    return ("UB" if with_barcodes else None) if tag.upper() == "AUTO" else tag


@dataclass(frozen=True)
class ReadParams:
    """Which reads count. excl_flag None: the default for the UMI mode."""

    cell_tag: str | None = "CB"
    umi_tag: str | None = "UB"
    min_mapq: float = 20
    min_len: int = 30
    incl_flag: int = 0
    excl_flag: int | None = None
    no_orphan: bool = True

    def __post_init__(self) -> None:
        if self.min_mapq < 0 or self.min_len < 0 or self.incl_flag < 0 or (self.excl_flag or 0) < 0:
            raise ValueError("read thresholds and flags must not be negative")

    @property
    def exclude(self) -> int:
        if self.excl_flag is not None:
            return self.excl_flag
        return EXCLUDE_UMI if self.umi_tag else EXCLUDE_READS


@dataclass(frozen=True)
class DepthParams(ReadParams):
    """min_include: a fraction of the aligned length if between 0 and 1, else a
    number of bases (so 1.0 asks for one base)."""

    min_include: float = 0.9
    all_regions: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.min_include < 0:
            raise ValueError("min_include must not be negative")


@dataclass(frozen=True)
class AlleleParams(ReadParams):
    min_count: int = 1
    min_maf: float = 0.0
    all_regions: bool = False
    no_dup_hap: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.min_count < 0 or not 0 <= self.min_maf <= 0.5:
            raise ValueError("min_count must not be negative and min_maf must lie in [0, 0.5]")


@dataclass(frozen=True)
class PhaseParams:
    """Eligibility of regions for local phasing, and the kernel's settings.
    init: warm (by the SNPs' own allele shares), current (no flips) or random."""

    min_len: int = 50_000
    min_snps: int = 2
    min_gap: int = 50_000
    min_expr_snps: int = 1
    baf_low: float = 0.45
    baf_high: float = 0.55
    min_iter: int = 5
    max_iter: int = 50
    em_min_iter: int = 10
    em_max_iter: int = 1000
    epsilon: float = 1e-3
    init: str = "warm"
    smooth_kernel: bool = True
    kernel_width: float = 20_000
    kernel_offset: float = 0.0
    smooth_hmm: bool = False
    hmm_diagonal: float = 0.99
    seed: int = 0

    def __post_init__(self) -> None:
        if self.init not in ("warm", "current", "random"):
            raise ValueError("init must be warm, current or random")


@dataclass(frozen=True)
class CorrectionParams:
    epsilon_hap: float = 0.01
    starts: int = 100
    max_iter: int = 1000
    epsilon: float = 1e-6
    seed: int = 0


def check_modes(with_barcodes: bool, with_samples: bool, cell_tag: str | None) -> None:
    """Cells come from a tag with barcodes, or from the files with sample ids."""
    if with_barcodes and with_samples:
        raise ValueError("give barcodes or sample ids, not both")
    if with_barcodes and not cell_tag:
        raise ValueError("barcodes need a cell tag")
    if cell_tag and not with_barcodes:
        raise ValueError("a cell tag needs barcodes")
