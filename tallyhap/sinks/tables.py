"""Matrices, result directories, variants, regions and genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_rows


def write_mtx(coo: DataFrame, path: str, n_rows: int, n_cols: int) -> int:
    """A coordinate matrix in order of row and column; returns its entries."""
    ordered = coo.select("row", "col", "value").orderBy("row", "col")
    return write_rows(ordered, path, lambda n: ["%%MatrixMarket matrix coordinate integer general", "%", f"{n_rows}\t{n_cols}\t{n}"])


def write_lines(df: DataFrame, path: str, header: list[str] = (), sep: str = "\t") -> int:
    return write_rows(df, path, lambda n: list(header), sep)


def write_allele_dir(path: str, features: DataFrame, cells: DataFrame, layers: dict[str, DataFrame], prefix: str = "allele.") -> dict[str, int]:
    """features (row, chrom, start, end_excl, name), cells (col, cell), and a
    coordinate matrix for each of AD, DP and OTH."""
    n_rows = write_lines(features.orderBy("row").select("chrom", "start", F.col("end_excl") - 1, "name"), f"{path}/{prefix}region.tsv")
    n_cols = write_lines(cells.orderBy("col").select("cell"), f"{path}/{prefix}samples.tsv")
    return {t: write_mtx(m, f"{path}/{prefix}{t}.mtx", n_rows, n_cols) for t, m in layers.items()}


def write_depth_dir(path: str, features: DataFrame, cells: DataFrame, counts: DataFrame) -> int:
    n_rows = write_lines(features.orderBy("row").select("chrom", "start", F.col("end_excl") - 1, "name"), f"{path}/features.tsv")
    n_cols = write_lines(cells.orderBy("col").select("cell"), f"{path}/barcodes.tsv")
    return write_mtx(counts, f"{path}/matrix.mtx", n_rows, n_cols)


def write_vcf(variants: DataFrame, header: list[str], path: str, order: str = "line_no") -> int:
    """variants under their header; columns that #CHROM lacks are added to it."""
    top = next(h for h in header if h.startswith("#CHROM"))
    columns = top.lstrip("#").split("\t")
    columns += [c for c in variants.columns if c not in (order, *columns)]
    lines = [h for h in header if h != top] + ["#" + "\t".join(columns)]
    return write_lines(variants.orderBy(order).select(*[f"`{c}`" for c in columns]), path, lines)


def write_pileup_dir(path: str, variants: DataFrame, header: list[str], cells: DataFrame, counts: DataFrame, genotypes: DataFrame | None = None, entries: str = "GT") -> None:
    """variants (row, ...), cells (col, cell), counts (row, col, ad, dp, oth);
    genotypes (row, col, v), whose v has the colon-separated entries."""
    n_rows = write_vcf(variants, header, f"{path}/cellSNP.base.vcf.gz", "row")
    n_cols = write_lines(cells.orderBy("col").select("cell"), f"{path}/cellSNP.samples.tsv")
    if genotypes is not None:  # (row, col, v): one entry for every variant and cell
        names = [r["cell"] for r in cells.orderBy("col").select("cell").collect()]
        wide = genotypes.groupBy("row").agg(*[F.max(F.when(F.col("col") == k, F.col("v"))).alias(s) for k, s in enumerate(names, 1)])
        fixed = variants.select("row", *[c for c in variants.columns if c not in ("row", "line_no", "FORMAT", *names)]).withColumn("FORMAT", F.lit(entries))
        write_vcf(fixed.join(wide, "row"), header, f"{path}/cellSNP.cells.vcf.gz", "row")
    for t in ("ad", "dp", "oth"):
        write_mtx(counts.where(F.col(t) > 0).select("row", "col", F.col(t).alias("value")), f"{path}/cellSNP.tag.{t.upper()}.mtx", n_rows, n_cols)


def write_by_chrom(variants: DataFrame, path: str) -> None:
    """A Parquet folder for each chromosome."""
    variants.write.mode("overwrite").partitionBy("CHROM").parquet(path)


def write_chrom_vcfs(variants: DataFrame, header: list[str], prefix: str, chroms: list[str], order: str = "line_no") -> dict[str, int]:
    """A file prefix.CHROM.vcf.gz for each listed chromosome, empty ones too;
    the chr prefix of names does not matter."""
    name = F.regexp_replace("CHROM", "^(?i:chr)", "")
    return {c: write_vcf(variants.where(name == c.removeprefix("chr")), header, f"{prefix}.{c}.vcf.gz", order) for c in chroms}


def write_regions(regions: DataFrame, path: str, kind: str = "tsv", with_name: bool = False) -> int:
    """BED of four columns, or TSV of three (four with the label)."""
    end = ["label"] if kind == "bed" or with_name else []
    start = F.col("start") - 1 if kind == "bed" else F.col("start")
    order = [c for c in ("chrom_no", "region_idx", "start") if c in regions.columns]
    return write_lines(regions.orderBy(*order).select("chrom", start.alias("start"), "end", *end), path)


def write_genes(genes: DataFrame, path: str, kind: str = "gtf", tags: tuple[str, str, str] = ("gene", "transcript", "exon")) -> int:
    """GTF or GFF3 lines of genes, transcripts and exons, under their tags."""
    def line(kind: str, start, end, ids) -> F.Column:  # noqa: E306
        return F.concat_ws("\t", "chrom", F.lit("."), F.lit(kind), start.cast("string"), end.cast("string"), F.lit("."), "strand", F.lit("."), ids)

    gff, text = kind.lower() == "gff3", lambda *x: F.concat(*[F.lit(v) if k % 2 == 0 else v for k, v in enumerate(x)])
    named = F.col("name").isNotNull() & ~F.col("name").isin("*", "#")
    gid = text("ID=", F.col("gene_id"), ";gene_id=", F.col("gene_id")) if gff else text('gene_id "', F.col("gene_id"), '"')
    gid = F.concat(gid, F.when(named, text(";gene_name=", F.col("name")) if gff else text('; gene_name "', F.col("name"), '"')).otherwise(""), F.lit("" if gff else ";"))
    g = genes.select("line_no", F.lit(0).alias("t"), F.lit(0).alias("x"), line(tags[0], F.col("start"), F.col("end"), gid).alias("v"))
    t = genes.select("line_no", "chrom", "strand", "gene_id", gid.alias("gid"), F.posexplode("transcripts").alias("k", "tr"))
    tran = F.col("tr")["tran_id"]
    tid = text("ID=", tran, ";Parent=", F.col("gene_id")) if gff else F.concat("gid", F.lit(' transcript_id "'), tran, F.lit('";'))
    tl = t.select("line_no", (F.col("k") + 1).alias("t"), F.lit(0).alias("x"), line(tags[1], F.col("tr")["start"], F.col("tr")["end"], tid).alias("v"))
    e = t.select("line_no", "chrom", "strand", "k", tid.alias("tid"), tran.alias("tran"), F.posexplode(F.col("tr")["exons"]).alias("j", "ex"))
    eid = F.concat(F.lit("ID="), "tran", F.lit("."), (F.col("j") + 1).cast("string"), F.lit(";Parent="), "tran") if gff else F.col("tid")
    el = e.select("line_no", (F.col("k") + 1).alias("t"), (F.col("j") + 1).alias("x"), line(tags[2], F.col("ex")["start"], F.col("ex")["end"], eid).alias("v"))
    return write_lines(g.unionByName(tl).unionByName(el).orderBy("line_no", "t", "x").select("v"), path)
