"""Domain constants that results depend on.

Everything here is data, not logic: label names, display names, thresholds,
coordinates, spelling fix-ups, token lists and rule patterns.  Operators take
most of them as defaults, so a caller may pass others.
"""

from __future__ import annotations

# --- fixed values: labels, in the order that decides ties -------------------
DEFAULT_LABELS = (
    "arama_kurtarma",
    "saglik",
    "barinma",
    "gida_su",
    "altyapi",
    "guvenlik",
    "lojistik",
    "psikolojik",
    "bilgi_paylasimi",
)

LABEL_NAMES = {
    "arama_kurtarma": "arama kurtarma",
    "saglik": "sağlık",
    "barinma": "barınma",
    "gida_su": "gıda su",
    "altyapi": "altyapı",
    "guvenlik": "güvenlik",
    "lojistik": "lojistik",
    "psikolojik": "psikolojik",
    "bilgi_paylasimi": "bilgi paylaşımı",
}

THRESHOLDS = {
    "arama_kurtarma": 0.5999999046325684,
    "saglik": 0.8999998569488525,
    "barinma": 0.929999828338623,
    "gida_su": 0.13999998569488525,
    "altyapi": 0.729999840259552,
    "guvenlik": 0.7399998903274536,
    "lojistik": 0.9099998474121094,
    "psikolojik": 0.8599998354911804,
    "bilgi_paylasimi": 0.8699998259544373,
}

# Columns that start with "pred_" but are no labels.
RESERVED_PRED_COLUMNS = ("pred_any_need", "pred_label_count")

# --- fixed values: places ---------------------------------------------------
PROVINCE_CENTROIDS = {
    "Hatay": (36.2022, 36.1606),
    "Adana": (37.0000, 35.3213),
    "Adıyaman": (37.7648, 38.2786),
    "Kahramanmaraş": (37.5753, 36.9228),
    "Gaziantep": (37.0662, 37.3833),
    "Diyarbakır": (37.9144, 40.2306),
    "Malatya": (38.3552, 38.3095),
    "Osmaniye": (37.0742, 36.2478),
    "Şanlıurfa": (37.1591, 38.7969),
    "Kilis": (36.7161, 37.1150),
}

PROVINCE_FIXUPS = {
    "Adiyaman": "Adıyaman",
    "Kahramanmaras": "Kahramanmaraş",
    "Diyarbakir": "Diyarbakır",
    "Sanliurfa": "Şanlıurfa",
}

UNKNOWN_PLACES = ("", "na", "n/a", "nan", "none", "null", "unknown", "<na>")

# Characters that betray UTF-8 bytes read as Latin-1: Ã Ä Å â and U+FFFD.
MOJIBAKE_MARKS = ("Ã", "Ä", "Å", "â", "�")

LOCAL_ZONE = "Europe/Istanbul"

# --- fixed values: information-sharing rule ---------------------------------
INFO_LABEL = "bilgi_paylasimi"
INFO_MIN_PROB = 0.20
INFO_MISSING = r"(haber\s+alam|haber\s+al[ıi]nam|ula[şs]am[ıi]yor|ula[şs][ıi]lam[ıi]yor)"
INFO_REQUEST = (
    r"(g[oö]ren|duyan|bilen|bilgisi\s+olan|bilgi\s+alan|haber\s+alan|ula[şs]s[ıi]n|yazs[ıi]n|bildirsin)"
)
INFO_CONTACT = r"(ileti[şs]im|irtibat|telefon|numara|0\d{10}|05\d{9})"
INFO_ANNOUNCEMENT = (
    r"(duyuru|canl[ıi]\s+yay[ıi]n|transfer|da[ğg][ıi]t[ıi]m|ula[şs]t[ıi]r[ıi]ld[ıi]|bildirilsin)"
)

# --- fixed values: hotspot severity, highest first --------------------------
SEVERITY_CUTS = ((0.95, "Kritik"), (0.80, "Yüksek"), (0.50, "Orta"))
SEVERITY_REST = "İzleme"

# --- fixed values: CSV cells read as missing --------------------------------
NA_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: kinds of a table ------------------------------------------
CANONICAL_KIND = "canonical_final"
DEFAULT_KIND = "custom"

# --- fixed values: report sizes ---------------------------------------------
TOP_MESSAGES_DEFAULT = 60
TICKER_ITEMS = 18
TICKER_CHARS = 140
TICKER_LABELS = 2
MESSAGE_LIST_ROWS = 500
PROVINCE_RANKING_ROWS = 10
HOTSPOT_LIST_ROWS = 12
HOUR_LABEL_ROWS = 6
URGENCY_RANGE_WHEN_EMPTY = (0.0, 10.0)
