"""Fixed data model: metric catalogue, table layouts and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DATASET_VERSION = 1
TRANSFORMATION_VERSION = "1.0.1"
NETWORK_CATEGORY = "main"
LOCAL_ZONE = "Europe/Paris"
MAX_STATIONS = 5
MAX_RESULT_ROWS = 100_000
DOUBTFUL = 2

# ---------------------------------------------------------------------------
# Source column names, metric groups, labels and department names.
# ---------------------------------------------------------------------------
DICTIONARY_SOURCE = "data/meteo_france/reference/H_descriptif_champs.csv"
IDENTITY_COLUMNS = ("NUM_POSTE", "NOM_USUEL", "LAT", "LON", "ALTI", "AAAAMMJJHH")

CORE_METRICS = (
    "RR1", "DRR1", "FF", "DD", "FXY", "DXY", "HXY", "FXI", "DXI", "HXI", "FXI3S", "DXI3S",
    "HFXI3S", "T", "TD", "TN", "HTN", "TX", "HTX", "DG", "U", "UN", "HUN", "UX", "HUX",
    "DHUMI40", "DHUMI80", "TSV", "PMER", "PSTAT", "PMERMIN", "GEOP", "N", "NBAS", "CL", "CM",
    "CH", "N1", "C1", "B1", "N2", "C2", "B2", "N3", "C3", "B3", "N4", "C4", "B4", "VV",
    "DVV200", "WW", "W1", "W2", "SOL", "SOLNG", "GLO", "GLO2", "DIR", "DIR2", "DIF", "DIF2",
    "UV", "UV2", "UV_INDICE", "INFRAR", "INFRAR2", "INS", "INS2",
)
STATUS_COLUMNS = ("STATUS_FXI3S", "STATUS_DXI3S")
SURFACE_METRICS = (
    "FF2", "DD2", "FXI2", "DXI2", "HXI2", "T10", "T20", "T50", "T100", "TNSOL", "TN50",
    "TCHAUSSEE", "DHUMEC",
)
MARINE_METRICS = ("TMER", "VVMER", "ETATMER", "DIRHOULE", "HVAGUE", "PVAGUE")
SNOW_METRICS = (
    "HNEIGEF", "NEIGETOT", "TSNEIGE", "TUBENEIGE", "HNEIGEFI3", "HNEIGEFI1", "ESNEIGE",
    "CHARGENEIGE",
)
WHOLE_NUMBER_METRICS = frozenset((
    "DD", "DXY", "HXY", "DXI", "HXI", "DXI3S", "HFXI3S", "HUN", "HUX", "HTN", "HTX", "DRR1",
    "DG", "DHUMI40", "DHUMI80", "DD2", "DXI2", "HXI2", "DHUMEC", "N", "NBAS", "CL", "CM", "CH",
    "N1", "C1", "B1", "N2", "C2", "B2", "N3", "C3", "B3", "N4", "C4", "B4", "DVV200", "WW",
    "W1", "W2", "SOL", "SOLNG", "VVMER", "ETATMER", "DIRHOULE", "ESNEIGE", "INS", "INS2",
))
DASHBOARD_COLUMNS = ("T", "TD", "TN", "TX", "U", "UN", "UX", "RR1", "FF", "DD", "PSTAT", "PMER")

METRIC_LABELS = {
    "RR1": "Hourly precipitation",
    "DRR1": "Precipitation duration",
    "FF": "Mean wind speed",
    "DD": "Mean wind direction",
    "FXY": "Maximum mean wind speed",
    "FXI": "Maximum instantaneous wind speed",
    "FXI3S": "Maximum 3-second wind speed",
    "T": "Air temperature",
    "TD": "Dew-point temperature",
    "TN": "Hourly minimum temperature",
    "TX": "Hourly maximum temperature",
    "DG": "Freezing duration",
    "U": "Relative humidity",
    "UN": "Hourly minimum relative humidity",
    "UX": "Hourly maximum relative humidity",
    "PMER": "Sea-level pressure",
    "PSTAT": "Station pressure",
    "N": "Total cloud cover",
    "VV": "Visibility",
    "WW": "Present weather",
    "GLO": "Global solar radiation",
    "INS": "Sunshine duration",
    "TMER": "Sea temperature",
    "ETATMER": "Sea state",
    "NEIGETOT": "Total snow depth",
    "TNSOL": "Near-ground minimum temperature",
}

DEPARTMENT_NAMES = {
    "01": "Ain", "02": "Aisne", "03": "Allier", "04": "Alpes-de-Haute-Provence",
    "05": "Hautes-Alpes", "06": "Alpes-Maritimes", "07": "Ardèche", "08": "Ardennes",
    "09": "Ariège", "10": "Aube", "11": "Aude", "12": "Aveyron", "13": "Bouches-du-Rhône",
    "14": "Calvados", "15": "Cantal", "16": "Charente", "17": "Charente-Maritime",
    "18": "Cher", "19": "Corrèze", "20": "Corse", "2A": "Corse-du-Sud", "2B": "Haute-Corse",
    "21": "Côte-d'Or", "22": "Côtes-d'Armor", "23": "Creuse", "24": "Dordogne", "25": "Doubs",
    "26": "Drôme", "27": "Eure", "28": "Eure-et-Loir", "29": "Finistère", "30": "Gard",
    "31": "Haute-Garonne", "32": "Gers", "33": "Gironde", "34": "Hérault",
    "35": "Ille-et-Vilaine", "36": "Indre", "37": "Indre-et-Loire", "38": "Isère",
    "39": "Jura", "40": "Landes", "41": "Loir-et-Cher", "42": "Loire", "43": "Haute-Loire",
    "44": "Loire-Atlantique", "45": "Loiret", "46": "Lot", "47": "Lot-et-Garonne",
    "48": "Lozère", "49": "Maine-et-Loire", "50": "Manche", "51": "Marne", "52": "Haute-Marne",
    "53": "Mayenne", "54": "Meurthe-et-Moselle", "55": "Meuse", "56": "Morbihan",
    "57": "Moselle", "58": "Nièvre", "59": "Nord", "60": "Oise", "61": "Orne",
    "62": "Pas-de-Calais", "63": "Puy-de-Dôme", "64": "Pyrénées-Atlantiques",
    "65": "Hautes-Pyrénées", "66": "Pyrénées-Orientales", "67": "Bas-Rhin", "68": "Haut-Rhin",
    "69": "Rhône", "70": "Haute-Saône", "71": "Saône-et-Loire", "72": "Sarthe", "73": "Savoie",
    "74": "Haute-Savoie", "75": "Paris", "76": "Seine-Maritime", "77": "Seine-et-Marne",
    "78": "Yvelines", "79": "Deux-Sèvres", "80": "Somme", "81": "Tarn",
    "82": "Tarn-et-Garonne", "83": "Var", "84": "Vaucluse", "85": "Vendée", "86": "Vienne",
    "87": "Haute-Vienne", "88": "Vosges", "89": "Yonne", "90": "Territoire de Belfort",
    "91": "Essonne", "92": "Hauts-de-Seine", "93": "Seine-Saint-Denis", "94": "Val-de-Marne",
    "95": "Val-d'Oise",
}
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class Metric:
    """One selectable dashboard metric."""

    name: str
    label: str
    unit: str
    statistics: tuple[str, ...]
    default_statistics: tuple[str, ...]

    @property
    def quality(self) -> str:
        return quality_column(self.name)


def quality_column(metric: str) -> str:
    return "Q" + metric


_SPREAD = ("average", "minimum", "maximum")
METRICS = {
    metric.name: metric
    for metric in (
        Metric("T", METRIC_LABELS["T"], "°C", _SPREAD, ("average",)),
        Metric("TD", METRIC_LABELS["TD"], "°C", _SPREAD, ("average",)),
        Metric("U", METRIC_LABELS["U"], "%", _SPREAD, ("average",)),
        Metric("RR1", METRIC_LABELS["RR1"], "mm", ("total", *_SPREAD), ("total",)),
        Metric("FF", METRIC_LABELS["FF"], "m/s", _SPREAD, ("average",)),
        Metric("PSTAT", METRIC_LABELS["PSTAT"], "hPa", _SPREAD, ("average",)),
    )
}

# Base metrics that decide whether a row belongs to a table.
TABLE_METRICS = {
    "hourly_core": CORE_METRICS,
    "hourly_surface": SURFACE_METRICS,
    "hourly_marine": MARINE_METRICS,
    "hourly_snow": SNOW_METRICS,
}
EXTENSION_TABLES = tuple(name for name in TABLE_METRICS if name != "hourly_core")


def table_columns(table: str) -> list[str]:
    """Metric columns of a fact table, each followed by its quality code."""
    columns = [c for base in TABLE_METRICS[table] for c in (base, quality_column(base))]
    return columns + list(STATUS_COLUMNS) if table == "hourly_core" else columns


def is_code(column: str) -> bool:
    """Quality and status columns hold small unsigned codes."""
    return column.startswith(("Q", "STATUS_"))


def source_type(column: str) -> str:
    """Logical type name of a metric column."""
    if is_code(column):
        return "uint8"
    return "uint16" if column in WHOLE_NUMBER_METRICS else "float"


# Spark has no unsigned types: the next wider signed type plus a range check.
SPARK_TYPES = {"uint8": T.ShortType(), "uint16": T.IntegerType(), "float": T.FloatType()}
UNSIGNED_LIMITS = {"uint8": 255, "uint16": 65_535}

COMMON_FIELDS = [
    T.StructField("department", T.StringType()),
    T.StructField("network_category", T.StringType()),
    T.StructField("NUM_POSTE", T.StringType()),
    T.StructField("NOM_USUEL", T.StringType()),
    T.StructField("LAT", T.DoubleType()),
    T.StructField("LON", T.DoubleType()),
    T.StructField("ALTI", T.IntegerType()),
    T.StructField("AAAAMMJJHH", T.StringType()),
    T.StructField("observation_time_utc", T.TimestampType()),
    # Spark has no per-column zone, so the local time is kept as a wall clock.
    T.StructField("observation_time_local", T.TimestampNTZType()),
    T.StructField("local_date", T.DateType()),
    T.StructField("local_hour", T.ShortType()),
    T.StructField("utc_offset_minutes", T.ShortType()),
    T.StructField("is_dst", T.BooleanType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_row_number", T.LongType()),
    T.StructField("source_sha256", T.StringType()),
    T.StructField("processing_run_id", T.StringType()),
]
COMMON_COLUMNS = [field.name for field in COMMON_FIELDS]


def fact_schema(table: str) -> T.StructType:
    """Stored schema of a fact table, including the ``year`` partition column."""
    metrics = [T.StructField(c, SPARK_TYPES[source_type(c)]) for c in table_columns(table)]
    return T.StructType([*COMMON_FIELDS, *metrics, T.StructField("year", T.IntegerType())])


KNOWN_CODE_COLUMNS = frozenset(
    c for table in TABLE_METRICS for c in table_columns(table) if c.startswith("Q")
)

SOURCE_FILE_FIELDS = [
    T.StructField("filename", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("period_start", T.LongType()),
    T.StructField("period_end", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime_ns", T.LongType()),
    T.StructField("sha256", T.StringType()),
]
SOURCE_FILE_SCHEMA = T.StructType(SOURCE_FILE_FIELDS)
