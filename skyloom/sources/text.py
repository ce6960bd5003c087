"""Text tables: CSV, TSV folders, blank-separated and fixed-width files, compressed or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import finite, without_nan
from ..functions.text import sexagesimal
from .columns import clean_header, sentinels_out

# Byte slices [from, to) of survey velocity files.
SURVEY_SLICES = {
    "APOGEE": {"sid": (27, 46), "ra": (47, 71), "dec": (72, 94), "rv": (95, 104), "erv": (105, 113), "srv": (114, 121)},
    "GALAH": {"sid": (25, 44), "ra": (45, 68), "dec": (69, 92), "rv": (93, 101), "erv": (102, 107), "srv": (107, 108)},
    "GES": {"sid": (25, 44), "ra": (45, 67), "dec": (68, 91), "rv": (92, 100), "erv": (101, 108), "srv": (109, 114)},
    "RAVE": {"sid": (25, 44), "ra": (45, 68), "dec": (69, 91), "rv": (92, 100), "erv": (101, 107), "srv": (108, 115)},
    "LAMOST": {"sid": (28, 47), "ra": (48, 70), "dec": (71, 94), "rv": (95, 103), "erv": (104, 110), "srv": (111, 118)},
}
# Byte slices of velocity tables of the literature, with sign and parts of a coordinate in one slice.
LITERATURE = {
    "Draco": {"slices": {"ra": (18, 29), "dec": (30, 41), "rv": (42, 49), "erv": (50, 54)}, "sexagesimal": True, "least": 49},
    "Walker": {"slices": {"target": (0, 8), "ra": (23, 34), "dec": (35, 46), "rv": (59, 65), "erv": (66, 70), "membership": (93, 98), "mean_rv": (99, 104), "mean_erv": (105, 108)}, "sexagesimal": True, "least": 70},
    "LeoI": {"slices": {"rv": (18, 24), "erv": (25, 28), "ra": (29, 40), "dec": (41, 52)}, "sexagesimal": True, "least": 52},
    "BooI": {"slices": {"ra": (24, 32), "dec": (33, 40), "rv": (51, 58), "erv": (59, 63), "flag": (83, 84)}, "sexagesimal": False, "least": 63},
}


def csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Numbers that are NaN or infinite are null, here as in all these readers."""
    return without_nan(clean_header(spark.read.csv(path, header=True, inferSchema=True, **options)))


def tsv_folder(spark: SparkSession, paths: list[str], key: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Union of TSV files that have the key column, others skipped; the key becomes text."""
    out = None
    for p in paths:
        df = without_nan(clean_header(spark.read.csv(p, header=True, sep="\t", inferSchema=True)))
        if key not in df.columns:
            continue
        df = df.withColumn(key, F.col(key).cast("string")).withColumn("source_file", F.input_file_name()).withColumnsRenamed(rename or {})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def blank_separated(spark: SparkSession, path: str, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """columns: name -> (position, type) of fields between blanks; what can't be read as its type is null."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter("trim(value) <> ''").select(*(F.try_element_at(part, F.lit(i + 1)).try_cast(t).alias(n) for n, (i, t) in columns.items())).transform(without_nan)


def fixed_width(spark: SparkSession, path: str, slices: dict[str, tuple[int, int]], types: dict[str, str] | None = None, least_length: int = 0) -> DataFrame:
    """Fields by [from, to); blanks are null, shorter lines skipped."""
    types = types or {}
    field = lambda n, a, b: F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit("")).try_cast(types.get(n, "double")).alias(n)
    return spark.read.text(path).filter(F.length("value") >= least_length).select(*(field(n, a, b) for n, (a, b) in slices.items())).transform(without_nan)


def files_of(spark: SparkSession, folder: str, patterns: list[str], most: int | None = None) -> list[str]:
    """Files of the first pattern that has any, in order of name, at most `most` of them; on any file system that Spark reads."""
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            return sorted(f.getPath().toString() for f in found)[:most]
    raise FileNotFoundError(f"{folder}: none of {patterns}")


def survey_velocities(spark: SparkSession, path: str, survey: str, slices: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A survey's fixed-width velocities: rows with a finite velocity and a finite positive error. A survey's name takes its
    own layout; its compressed file comes before the plain one if path is their folder."""
    if not path.endswith((".dat", ".gz", ".txt")):
        path = files_of(spark, path, [f"{survey.lower()}.dat.gz", f"{survey.lower()}.dat"])[0]
    df = fixed_width(spark, path, slices or SURVEY_SLICES[survey], {"sid": "string"})
    return df.filter("rv IS NOT NULL AND erv > 0").withColumn("survey", F.lit(survey))


def literature_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the known tables: ra and dec in degrees, rv, erv (null for a dash), and what else the layout has; short lines and
    those without place or velocity go."""
    known = LITERATURE[name]
    own = {c: s for c, s in known["slices"].items() if c not in ("target", "flag")}
    texts = {c: "string" for c in known["slices"] if c not in own}
    df = fixed_width(spark, path, known["slices"], {"ra": "string", "dec": "string", **texts}, known["least"])
    place = {"ra": sexagesimal(F.col("ra"), True), "dec": sexagesimal(F.replace("dec", F.lit("- "), F.lit("-")))} if known["sexagesimal"] else {c: finite(F.col(c).try_cast("double")) for c in ("ra", "dec")}
    return df.withColumns(place).dropna(subset=["ra", "dec", "rv"]).withColumn("source", F.lit(name))


def literature(spark: SparkSession, path: str, slices: dict[str, tuple[int, int]], ra: str, dec: str, sexagesimal_place: bool, least_length: int = 1) -> DataFrame:
    """Fixed-width table of the literature; its coordinates are given in degrees whichever form they have."""
    df = fixed_width(spark, path, slices, {ra: "string", dec: "string"}, least_length)
    place = {ra: sexagesimal(F.col(ra), True), dec: sexagesimal(F.col(dec))} if sexagesimal_place else {c: finite(F.col(c).try_cast("double")) for c in (ra, dec)}
    return df.withColumns(place).dropna(subset=[ra, dec])


def dwarf_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose -999 stand for nothing; needs RA, DEC and v, rows without them go."""
    df = csv(spark, path)
    if missing := {"RA", "DEC", "v"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    numeric = [c for c in df.columns if c not in ("Galaxy", "name")]
    return sentinels_out(df, numeric).dropna(subset=["RA", "DEC", "v"])


def limited_files(spark: SparkSession, paths: list[str], rows_per_file: int | None = None, max_files: int | None = None) -> DataFrame:
    """Parquet files in order of name, at most max_files, each cut to its first rows_per_file rows (a limit asked for). One scan of
    all files, whatever their number; a column that only some have is null in the others."""
    df = spark.read.option("mergeSchema", True).parquet(*sorted(paths)[:max_files])
    if rows_per_file is not None:
        df = df.filter(F.col("_metadata.row_index") < rows_per_file)
    return without_nan(df)


def truth_list(spark: SparkSession, path: str) -> DataFrame:
    """By extension: FITS, else CSV; its coordinates as ra, dec whatever they are called."""
    from .columns import with_aliases

    df = spark.read.format("fits").load(path) if path.lower().endswith((".fits", ".fit")) else csv(spark, path)
    return with_aliases(df, {"ra": ["RAdeg", "RA_ICRS", "ra_x", "RAJ2000"], "dec": ["DEdeg", "DE_ICRS", "dec_x", "DEJ2000"]})
