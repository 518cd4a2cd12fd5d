"""Record types and small dimensions of the assessment model."""

from __future__ import annotations

from pyspark.sql import types as T

AFBS = ["AFB1", "AFB2", "AFB3"]

# Competences in display order, with their short keys K1 to K6.
COMPETENCES = ["Argumentieren", "Problemlösen", "Modellieren", "Darstellungen", "Mathematik", "Kommunizieren"]

# Classes and their topics in order.
TOPICS_BY_CLASS = {
    "7": ["Terme", "Rationale Zahlen", "Gleichungen", "Prozentrechnung", "Zuordnung"],
    "8": ["Terme & Gleichungen", "Prozent- und Zinsrechnung", "Flächen", "Körper", "Statistik", "Funktionen"],
    "9": ["Gleichungssysteme", "Lineare Funktionen", "Potenzen", "Dreiecke", "Körper - Fortgeschritten"],
    "10": ["Quadratische Funktionen", "Exponentialfunktionen", "Trigonometrie", "Wahrscheinlichkeitsrechnung"],
    "11": [],
    "12": [],
    "13": [],
}

# Topics visited right after the preferred one.
RELATED_TOPICS = {"Terme": ["Gleichungen"], "Gleichungen": ["Terme"]}

# Keywords of the topics.
TOPIC_KEYWORDS = {
    "Terme": ["term", "variable", "klammer", "ausmultipl", "zusammenfass"],
    "Rationale Zahlen": ["rational", "negative zahl", "zahlengerade", "bruch", "dezimal", "vorzeichen", "betrag"],
    "Gleichungen": ["gleichung", "äquivalenz", "variable", "lösen"],
    "Prozentrechnung": ["prozent", "grundwert", "prozentwert", "prozentsatz", "rabatt"],
    "Zuordnung": ["zuordnung", "proportional", "dreisatz", "tabelle"],
    "Terme & Gleichungen": ["term", "gleichung", "variable", "klammer", "äquivalenz"],
    "Prozent- und Zinsrechnung": ["prozent", "zins", "kapital", "rabatt", "wachstumsfaktor"],
    "Flächen": ["fläche", "flächeninhalt", "umfang", "dreieck", "viereck", "kreis"],
    "Körper": ["volumen", "oberfläche", "prisma", "zylinder", "körper"],
    "Statistik": ["median", "mittelwert", "boxplot", "histogramm", "daten", "diagramm", "säulendiagramm"],
    "Funktionen": ["funktion", "graph", "steigung", "y-achse", "koordinatensystem"],
    "Gleichungssysteme": ["gleichungssystem", "lgs", "einsetz", "additionsverfahren", "zwei gleichungen"],
    "Lineare Funktionen": ["linear", "steigung", "y-achsenabschnitt", "funktionsgleichung", "gerade"],
    "Potenzen": ["potenz", "exponent", "wurzel", "zehnerpotenz", "potenzgesetz"],
    "Dreiecke": ["dreieck", "pythagoras", "thales", "winkel", "kongruenz"],
    "Körper - Fortgeschritten": ["pyramide", "kegel", "kugel", "volumen", "oberfläche"],
    "Quadratische Funktionen": ["quadratisch", "parabel", "scheitel", "nullstelle", "binom"],
    "Exponentialfunktionen": ["exponential", "wachstum", "zerfall", "wachstumsfaktor", "halbwert"],
    "Trigonometrie": ["sinus", "kosinus", "tangens", "trigonom", "winkel"],
    "Wahrscheinlichkeitsrechnung": ["wahrscheinlichkeit", "baumdiagramm", "urne", "ereignis", "vierfelder", "zufall", "boxplot"],
}

# Fixed values: (percent, grade points).
GRADES = [(0, 0), (9, 1), (18, 2), (27, 3), (36, 4), (45, 5), (50, 6), (60, 7), (65, 8), (70, 9), (75, 10), (80, 11), (85, 12), (90, 13), (95, 14), (100, 15)]

SUB_TASK = T.StructType([T.StructField("label", T.StringType()), T.StructField("is_star", T.BooleanType()), T.StructField("afb", T.StringType()), T.StructField("points", T.DoubleType())])

TASK = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "question_text", "competence", "topic", "class_level")]
    + [T.StructField("max_points", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("points_raw", "afb_raw")]
    + [T.StructField("estimated_time", T.DoubleType()), T.StructField("expectation", T.StringType()), T.StructField("image_url", T.StringType()), T.StructField("on_extra_sheet", T.BooleanType())]
    + [T.StructField("points_by_afb", T.MapType(T.StringType(), T.DoubleType())), T.StructField("sub_tasks", T.ArrayType(SUB_TASK))]
)

#: Confidences of a draft's fields.
CONFIDENCE = "struct<topic:double,competence:double,afb:double,time:double,expectation:double>"

#: What an external model returns for a draft; a field that does not parse becomes null.
MODEL_JSON = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "topic", "competence", "afbRaw", "pointsRaw", "expectation")]
    + [T.StructField(n, T.DoubleType()) for n in ("estimatedTime", "confidenceTopic", "confidenceCompetence", "confidenceAfb", "confidenceTime", "confidenceExpectation")]
)
