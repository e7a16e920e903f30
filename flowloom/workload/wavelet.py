"""Queries: wavelet operators."""

from pyspark.sql import functions as F

from flowloom.functions import wavelet as V
from flowloom.operators.bounds import fetched
from flowloom.workload.inputs import GEOM, K, LABELLED_WIDTH, WIDTH, labelled_vectors, swt_ctes, vectors, with_
from flowloom.workload.registry import query, r

GEOM_LABELLED = V.geometry(LABELLED_WIDTH)
BANDS = tuple(b.lower() for b in V.SUBBANDS)
_SWT = with_("vectors", more=swt_ctes("vectors", "features"))
_BAND_COLS = {"cD1": "d1", "cD2": "d2", "cD3": "d3", "cA3": "a3"}


def subbands(spark, sf):
    return V.with_subbands(vectors(spark, sf), "features", GEOM)


def _rounded(df):
    return df.withColumns({b: F.round(b, 6) for b in V.SUBBANDS})


# Padded to a multiple of 8, laid out as a square that three halvings leave with a side of two at least.
@query("swt_geometry", """WITH w AS (SELECT len(embedding)::INT AS n_features, count(*) AS n_rows FROM embeddings GROUP BY 1),
 p AS (SELECT *, ((n_features + 7) // 8 * 8)::INT AS n_padded FROM w), s AS (SELECT *, ceil(sqrt(n_padded))::INT AS own FROM p),
 g AS (SELECT *, greatest(own, 9)::INT AS side FROM s)
SELECT n_features, n_rows, n_padded, side, CASE WHEN side > own THEN own END AS raised_from, ((side + 7) // 8)::INT AS final_side,
 (side * side - n_padded)::INT AS image_pad FROM g""")
def swt_geometry(spark, sf):
    widths = vectors(spark, sf).groupBy(F.size("features").alias("n_features")).agg(F.count(F.lit(1)).alias("n_rows"))
    rows = []
    for w in fetched(widths, "vector widths").to_pylist():
        g = V.geometry(w["n_features"])
        rows.append((w["n_features"], w["n_rows"], g.n_padded, g.side, g.raised_from, g.final_side, g.image_pad))
    return spark.createDataFrame(
        rows, "n_features int, n_rows long, n_padded int, side int, raised_from int, final_side int, image_pad int"
    )


# The padded width is the next multiple of 2^3.
_N, _PAD_N = LABELLED_WIDTH, -(-LABELLED_WIDTH // 8) * 8
_WIDE = "list_append(list_transform(features, lambda v: v::DOUBLE), y_true::DOUBLE)"
_PADDED = f"""wide AS (SELECT row_key, {_WIDE} AS f FROM vectors),
 padded AS (SELECT row_key, list_transform(range(0, {_PAD_N}), lambda i: f[CASE WHEN i < {_N} THEN i + 1 ELSE 2 * {_N} - 1 - i END]) AS x FROM wide)"""
PADDED_SWT = f"{_PADDED}, {swt_ctes('padded', 'x', n=_PAD_N)}"


@query("pad_reflect", with_("vectors", more=_PADDED) + f"SELECT row_key, i::INT AS pos, {r('x[i + 1]')} AS v FROM padded, range(0, {_PAD_N}) t(i)")
def pad_reflect(spark, sf):
    padded = labelled_vectors(spark, sf).select("row_key", F.posexplode(V.pad_reflect("x", GEOM_LABELLED)).alias("pos", "v"))
    return padded.withColumn("v", F.round(F.col("v").cast("double"), 6))


_LONG = ", ".join(f"{r(f'{c}[i + 1]')} AS \"{b}\"" for b, c in _BAND_COLS.items())


@query("swt_subbands", _SWT + f"SELECT row_key, i::INT AS pos, {_LONG} FROM w3, range(0, {WIDTH}) t(i)")
def swt_subbands(spark, sf):
    return _rounded(V.band_positions(subbands(spark, sf), "subbands", GEOM, "row_key"))


def _cells(df):
    """(row_key, band, cell, value) of an image column."""
    rows = df.select("row_key", F.posexplode("image").alias("band", "_b"))
    flat = rows.select("row_key", "band", F.posexplode(F.flatten("_b")).alias("cell", "_v"))
    return flat.select("row_key", "band", "cell", F.round(F.col("_v").cast("double"), 5).alias("value"))


def _image(width: int, cells: int) -> str:
    return " UNION ALL ".join(
        f"SELECT row_key, {n} AS band, i::INT AS cell, {r(f'CASE WHEN i < {width} THEN {c}[i + 1] ELSE 0 END::FLOAT', 5)} AS value FROM w3, range(0, {cells}) t(i)"
        for n, c in enumerate(_BAND_COLS.values())
    )


@query("subband_image", _SWT + _image(64, 81))
def subband_image(spark, sf):
    return _cells(subbands(spark, sf).select("row_key", V.subband_image("subbands", GEOM).alias("image")))


@query("swt_transform", with_("vectors", more=PADDED_SWT) + _image(_PAD_N, GEOM_LABELLED.side**2))
def swt_transform(spark, sf):
    return _cells(V.swt_images(labelled_vectors(spark, sf), "x", GEOM_LABELLED))


_ENERGY = {b: f"list_sum(list_transform({c}, lambda v: v * v))" for b, c in _BAND_COLS.items()}


@query("subband_energy", _SWT + "SELECT row_key, " + ", ".join(f"{r(e)} AS \"{b}\"" for b, e in _ENERGY.items()) + " FROM w3")
def subband_energy(spark, sf):
    e = subbands(spark, sf).select("row_key", V.subband_energy("subbands").alias("e"))
    return _rounded(e.select("row_key", *[F.get("e", i).alias(b) for i, b in enumerate(V.SUBBANDS)]))


def energy(spark, sf):
    classes = spark.range(K).select(F.col("id").cast("int").alias("y_true"))
    return V.energy_by_class(subbands(spark, sf), "subbands", "y_true", classes)


_BY_CLASS = f"""en AS (SELECT c AS y_true, {", ".join(f"coalesce(avg({e}), 0) AS {b.lower()}" for b, e in _ENERGY.items())}
 FROM codes LEFT JOIN w3 ON y_true = c GROUP BY 1)"""
ENERGY_CTES = with_("vectors", "codes", more=f"{swt_ctes('vectors', 'features')}, {_BY_CLASS}")


@query("energy_by_class", ENERGY_CTES + "SELECT y_true, " + ", ".join(f"{r(b.lower())} AS \"{b}\"" for b in V.SUBBANDS) + " FROM en")
def energy_by_class(spark, sf):
    return _rounded(energy(spark, sf))


_TOTAL = "(cd1 + cd2 + cd3 + ca3)"
SHARE_SQL = ENERGY_CTES + "SELECT y_true, " + ", ".join(
    f"{r(f'CASE WHEN {_TOTAL} > 0 THEN {b.lower()} / {_TOTAL} ELSE 0 END')} AS \"{b}\"" for b in V.SUBBANDS
) + " FROM en"


@query("energy_share", SHARE_SQL)
def energy_share(spark, sf):
    return _rounded(V.energy_share(energy(spark, sf)))


@query("unfold_positions", with_("vectors", more=PADDED_SWT) + f"SELECT row_key, i::INT AS pos, {_LONG} FROM w3, range(0, {_N}) t(i)")
def unfold_positions(spark, sf):
    bands = V.with_subbands(labelled_vectors(spark, sf), "x", GEOM_LABELLED)
    return _rounded(V.band_positions(bands, "subbands", GEOM_LABELLED, "row_key"))
