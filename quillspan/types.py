"""Entity types: priority order, label normalisation and display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The closed set of types, whether values are compared without separators, and their names.
TYPES = [
    ("EMAIL", False, "E-mail", "Email"),
    ("TELEPHONE", True, "Téléphone", "Phone"),
    ("IBAN", True, "IBAN", "IBAN"),
    ("NIR", True, "N° de sécurité sociale", "French social security number"),
    ("CARTE_BANCAIRE", True, "Carte bancaire", "Bank card"),
    ("DATE", False, "Date", "Date"),
    ("ADRESSE", False, "Adresse", "Address"),
    ("IP", False, "Adresse IP", "IP address"),
    ("URL", False, "Lien", "Link"),
    ("IDENTIFIANT", False, "Identifiant", "Identifier"),
    ("PERSONNE", False, "Personne", "Person"),
    ("LIEU", False, "Lieu", "Place"),
    ("NOM_PROPRE", False, "Nom propre", "Proper noun"),
    ("MASQUE", False, "Masqué", "Masked"),
]
COMPACT = [t for t, compact, _, _ in TYPES if compact]


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "type string, compact boolean, label_fr string, label_en string")
