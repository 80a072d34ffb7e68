"""Named tables: where they lie, how they are read, which roles their columns have."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators.cells import all_but, assert_no_holes, drop_holes, named_like, project
from lacuna.operators.position import with_position
from lacuna.roles import Roles
from lacuna.sources.arff import read_arff
from lacuna.sources.delimited import read_delimited

KEY = "row_id"


@dataclass(frozen=True)
class Table:
    """A catalog entry. ``roles`` sees the loaded columns, so lists can be derived from them."""

    file: str
    read: Callable[[SparkSession, str], DataFrame]
    roles: Callable[[DataFrame], Roles]
    key: str = KEY
    drop_rows_with_holes: bool = False


def _typed(names, kind="double", **other):
    return {n: other.get(n.replace(" ", "_"), kind) for n in names}


def _fixed(continuous, categorical, target, integer=()):
    return lambda df: Roles(KEY, tuple(continuous), tuple(categorical), tuple(integer), target)


# Column names and roles of the public data sets, in file order
ABALONE = ["Sex", "Length", "Diameter", "Height", "Whole weight", "Shucked weight", "Viscera weight", "Shell weight", "Rings"]
BANKNOTE = ["variance", "skewness", "curtosis", "entropy", "class"]
BREAST = ["radius", "texture", "perimeter", "area", "smoothness", "compactness", "concavity", "concave points", "symmetry", "fractal dimension"]
CONCRETE = ["Cement", "Blast Furnace Slag", "Fly Ash", "Water", "Superplasticizer", "Coarse Aggregate", "Fine Aggregate", "Age", "Concrete compressive strength"]
KINGS_FILE = ["id", "date", "price", "bedrooms", "bathrooms", "sqft_living", "sqft_lot", "floors", "waterfront", "view", "condition", "grade", "sqft_above", "sqft_basement", "yr_built", "yr_renovated", "zipcode", "lat", "long", "sqft_living15", "sqft_lot15"]
KINGS_CONTINUOUS = ["price", "sqft_living", "sqft_lot", "sqft_above", "sqft_basement", "yr_built", "yr_renovated", "lat", "long", "sqft_living15", "sqft_lot15"]
KINGS_CATEGORICAL = ["bedrooms", "bathrooms", "floors", "waterfront", "view", "condition", "grade"]
KINGS_INTEGER = ["price", "sqft_living", "sqft_lot", "sqft_above", "sqft_basement", "yr_built", "yr_renovated", "sqft_living15", "sqft_lot15"]
LETTER = ["lettr", "x-box", "y-box", "width", "high", "onpix", "x-bar", "y-bar", "x2bar", "y2bar", "xybar", "x2ybr", "xy2br", "x-ege", "xegvy", "y-ege", "yegvx"]
LOAN_FILE = ["ID", "Age", "Experience", "Income", "ZIP Code", "Family", "CCAvg", "Education", "Mortgage", "Personal Loan", "Securities Account", "CD Account", "Online", "CreditCard"]
LOAN_CONTINUOUS = ["Age", "Experience", "Income", "CCAvg", "Mortgage"]
LOAN_CATEGORICAL = ["Family", "Personal Loan", "Securities Account", "CD Account", "Online", "CreditCard"]
LOAN_INTEGER = ["Age", "Experience", "Income", "Mortgage"]
WINE = ["fixed acidity", "volatile acidity", "citric acid", "residual sugar", "chlorides", "free sulfur dioxide", "total sulfur dioxide", "density", "pH", "sulphates", "alcohol", "quality"]
ANURAN_LABELS = ["Family", "Genus", "Species"]
ANURAN_COEFFICIENTS = 22
NOMAO_CATEGORICAL = [7, 8, 15, 16, 23, 24, 31, 32, 39, 40, 47, 48, 55, 56, 63, 64, 71, 72, 79, 80, 87, 88, 92, 96, 100, 104, 108, 112, 116]
NOMAO_COLUMNS = 118
YEAST_NUMBERS = 103
YEAST_CLASSES = 14

BREAST_NUMBERS = [f"{n}{i}" for i in (1, 2, 3) for n in BREAST]
ANURAN_FILE = [f"MFCCs_{i:>2}" for i in range(1, ANURAN_COEFFICIENTS + 1)] + ANURAN_LABELS + ["RecordID"]


def _csv(columns, **options):
    return lambda spark, path: read_delimited(spark, path, columns, **options)


def _wine(df):
    return Roles(KEY, tuple(all_but(df, "quality", KEY)), ("quality",), (), "quality")


def _anuran(df):
    return Roles(KEY, tuple(named_like(df, "MFCCs_")), tuple(ANURAN_LABELS), (), "Species")


def _nomao(df):
    nominal = [f"V{i}" for i in NOMAO_CATEGORICAL]
    numbers = [f"V{i}" for i in range(1, NOMAO_COLUMNS + 1) if i not in NOMAO_CATEGORICAL]
    return Roles(KEY, tuple(numbers), (*nominal, "Class"), (), "Class")


CATALOG: dict[str, Table] = {
    "abalone": Table("abalone.data", _csv(_typed(ABALONE, Sex="string", Rings="int")),
                     _fixed([c for c in ABALONE if c not in ("Sex", "Rings")], ["Sex", "Rings"], "Rings")),
    "anuran": Table("Frogs_MFCCs.csv", _csv(_typed(ANURAN_FILE, Family="string", Genus="string", Species="string", RecordID="int"), header=True), _anuran),
    "banknote": Table("data_banknote_authentication.txt", _csv(_typed(BANKNOTE, **{"class": "int"})),
                      _fixed(BANKNOTE[:-1], ["class"], "class")),
    "breast": Table("wdbc.data", lambda spark, path: read_delimited(
        spark, path, {"id": "bigint", "Diagnosis": "string", **_typed(BREAST_NUMBERS)}).drop("id"),
        _fixed(BREAST_NUMBERS, ["Diagnosis"], "Diagnosis")),
    "concrete": Table("Concrete_Data.csv", _csv(_typed(CONCRETE, Age="int"), header=True, replace_header=True),
                      _fixed([c for c in CONCRETE if c != "Age"], ["Age"], "Age")),
    "kings": Table("kc_house_data.csv", _csv(_typed(KINGS_FILE, id="bigint", date="string", zipcode="int"), header=True),
                   _fixed(KINGS_CONTINUOUS, KINGS_CATEGORICAL, "grade", KINGS_INTEGER)),
    "letter": Table("letter-recognition.data", _csv(_typed(LETTER, "int", lettr="string")),
                    _fixed(LETTER[1:], ["lettr"], "lettr", LETTER[1:])),
    "loan": Table("Bank_Personal_Loan_Modelling.csv", _csv(_typed(LOAN_FILE), header=True),
                  _fixed(LOAN_CONTINUOUS, LOAN_CATEGORICAL, "Personal Loan", LOAN_INTEGER), drop_rows_with_holes=True),
    "redwine": Table("winequality-red.csv", _csv(_typed(WINE, quality="int"), header=True, separator=";"), _wine),
    "whitewine": Table("winequality-white.csv", _csv(_typed(WINE, quality="int"), header=True, separator=";"), _wine),
    "nomao": Table("nomao.arff", read_arff, _nomao),
    "yeast": Table("yeast.arff", read_arff, _fixed([f"attr{i}" for i in range(1, YEAST_NUMBERS + 1)],
                                                  [f"class{i}" for i in range(1, YEAST_CLASSES + 1)], "class14")),
}


def register(name: str, table: Table) -> None:
    """Add a table of one's own."""
    CATALOG[name] = table


def parquet_table(file: str, roles: Roles) -> Table:
    """A parquet table that has its own key column."""
    return Table(file, lambda spark, path: spark.read.parquet(path), lambda df: roles, key=roles.key)


def load(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, Roles]:
    """The table in role order with a key, checked for holes, and its roles.

    A file without a key gets the row's position under the order of all its columns.
    """
    if name not in CATALOG:
        raise ValueError(f"unknown table {name!r}, one of {sorted(CATALOG)}")
    entry = CATALOG[name]
    df = entry.read(spark, f"{folder.rstrip('/')}/{entry.file}")
    roles = entry.roles(df)
    if entry.drop_rows_with_holes:
        df = drop_holes(df, roles.features)
    if roles.key not in df.columns:
        names = [f"`{f}`" for f in roles.features]
        df = with_position(df.select(*names), names, roles.key)
    df = project(df, roles)
    return assert_no_holes(df, roles.features), roles
