"""Risk score and verdict from signals, with plain aggregates and small lookup tables.

A *signal* row is (doc_id, nivel, titulo, detalle).  A document's score is the sum of its signals'
weights, at most 100; the verdict follows from thresholds; a document that could not be read is
``desconocido`` with score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight of each level, thresholds of the verdict, highest score.
WEIGHTS = {"alto": 40, "medio": 15, "bajo": 5}
HIGH, MIDDLE, MOST = 40, 15, 100
#: What to do, by verdict.
RECOMMENDATIONS = {
    "alto": "No lo abras ni lo proceses con privilegios normales sin comprobarlo antes: mejor en una máquina aislada, o pide el archivo en un formato sin macros/código (.docx en vez de .docm, PDF sin JavaScript).",
    "medio": "Revisa el detalle antes de confiar en el archivo a ciegas; nada aquí ejecuta código sin que tú o el programa que lo abra deis un paso más, pero puede intentar acceder a redes o rutas de fuera.",
    "bajo": "No se han encontrado señales de contenido activo o credenciales expuestas en la estructura del archivo. Esto no es un análisis de malware: solo mira la estructura, no el contenido.",
    "desconocido": "No se ha podido leer la estructura del archivo (formato no soportado o cifrado); no se puede evaluar el riesgo.",
}


def weight(nivel: Column) -> Column:
    out = F.lit(0)
    for level, w in WEIGHTS.items():
        out = F.when(nivel == level, F.lit(w)).otherwise(out)
    return out


def verdict_of(score: Column) -> Column:
    return F.when(score >= HIGH, "alto").when(score >= MIDDLE, "medio").otherwise("bajo")


def recommendations(spark: SparkSession) -> DataFrame:
    """The lookup table riesgo -> recomendacion: four rows."""
    return spark.createDataFrame(list(RECOMMENDATIONS.items()), "riesgo string, recomendacion string")


def score(signals: DataFrame) -> DataFrame:
    """doc_id, puntuacion, n_signals; one partial aggregate before the shuffle."""
    return signals.groupBy("doc_id").agg(F.least(F.lit(MOST), F.sum(weight(F.col("nivel")))).cast("int").alias("puntuacion"), F.count("*").alias("n_signals"))


def verdicts(documents: DataFrame, signals: DataFrame, *, supported: Column | None = None) -> DataFrame:
    """doc_id, riesgo, puntuacion, n_signals of every document; those without signals get 0 and ``bajo``.

    ``supported`` is a condition over ``documents``; where it is false the verdict is ``desconocido``.
    """
    readable = documents.select("doc_id", (F.lit(True) if supported is None else F.coalesce(supported, F.lit(True))).alias("__ok"))
    joined = readable.join(score(signals), "doc_id", "left")
    points = F.when(F.col("__ok"), F.coalesce("puntuacion", F.lit(0))).otherwise(F.lit(0))
    return joined.select(
        "doc_id",
        F.when(F.col("__ok"), verdict_of(points)).otherwise("desconocido").alias("riesgo"),
        points.alias("puntuacion"),
        F.when(F.col("__ok"), F.coalesce("n_signals", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_signals"),
    )


def with_recommendation(verdict: DataFrame) -> DataFrame:
    """Join the four-row lookup table, which is always small enough to broadcast."""
    return verdict.join(F.broadcast(recommendations(verdict.sparkSession)), "riesgo", "left")


def with_signals(verdict: DataFrame, signals: DataFrame) -> DataFrame:
    """Add ``hallazgos``, the list of a document's signals by level and title."""
    rank = F.when(F.col("nivel") == "alto", 0).when(F.col("nivel") == "medio", 1).otherwise(2)
    listed = signals.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "titulo", "detalle", "nivel"))).alias("h"))
    named = F.transform("h", lambda x: F.struct(x["nivel"].alias("nivel"), x["titulo"].alias("titulo"), x["detalle"].alias("detalle")))
    empty = F.array().cast("array<struct<nivel:string,titulo:string,detalle:string>>")
    return verdict.join(listed, "doc_id", "left").withColumn("hallazgos", F.coalesce(named, empty)).drop("h")


#: Signals of findings.  kind, level, title, detail; the condition is in :func:`signals_of_findings`.
SIGNALS = {
    "macros": ("office", "alto", "Macros incrustadas (VBA)"),
    "connection": ("office", "alto", "Conexión a una base de datos externa"),
    "links": ("office", "medio", "Enlaces a otros archivos"),
    "pivot": ("office", "medio", "Tabla dinámica con origen externo"),
    "names": ("office", "medio", "Nombres definidos que apuntan fuera del archivo"),
    "hidden": ("office", "bajo", "Hojas ocultas"),
    "code": ("pdf", "alto", "Código que se ejecuta al abrir el PDF"),
    "attached": ("pdf", "medio", "Archivos incrustados dentro del PDF"),
}
#: The label or the group of findings that each signal stands for.
BY_LABEL = {
    "Macros (vbaProject.bin)": "macros",
    "Conexiones a bases de datos": "connection",
    "Enlace a otro libro": "links",
    "Tabla dinámica con origen externo": "pivot",
    "Nombres definidos apuntando a otros archivos": "names",
}
BY_GROUP = {"Excel · hojas ocultas": "hidden", "JavaScript": "code", "Adjuntos": "attached"}


def signals_of_findings(findings: DataFrame) -> DataFrame:
    """One signal for each rule that a document's findings meet; images have none.

    ``findings`` has doc_id, kind, grp, label, value.  The detail of a signal is the number of
    findings behind it and the smallest of their values.
    """
    rule = F.lit(None).cast("string")
    for group, name in BY_GROUP.items():
        rule = F.when(F.col("grp") == group, F.lit(name)).otherwise(rule)
    for label, name in BY_LABEL.items():
        rule = F.when(F.col("label") == label, F.lit(name)).otherwise(rule)
    met = findings.withColumn("rule", rule).filter(F.col("rule").isNotNull()).groupBy("doc_id", "kind", "rule").agg(F.count("*").alias("n"), F.min("value").alias("first"))
    rules = findings.sparkSession.createDataFrame([(k, *v) for k, v in SIGNALS.items()], "rule string, kind string, nivel string, titulo string")
    return met.join(F.broadcast(rules), ["rule", "kind"]).select("doc_id", "nivel", "titulo", F.concat(F.col("n").cast("string"), F.lit(": "), F.col("first")).alias("detalle"))
