"""Column-role resolution from header names (driver-side metadata on ``df.columns``).

Station files name measures in long upper-case Portuguese headers whose accents vary
between years (``PRESSÃO`` / ``PRESSAO``).  Names are accent-folded and upper-cased before
the keyword search, so ``MÁXIMA`` matches ``MAX``.
"""

from __future__ import annotations

import unicodedata

# Header keywords and candidate names that must match the reference.
TIME_COLUMN_NAMES = ["Data", "Hora", "Data Medicao", "Hora Medicao", "DATA (YYYY-MM-DD)", "HORA (UTC)"]
TRAINING_EXCLUDED_COLUMNS = ["datetime", "data_temp", "hora_temp"] + TIME_COLUMN_NAMES
DATE_KEYWORDS = ["DATA", "DATE", "DIA", "DAY"]
HOUR_KEYWORDS = ["HORA", "HOUR", "TIME", "TEMPO"]
HOUR_EXCLUDED_KEYWORD = "HORARIA"
RAIN_KEYWORDS = ["PRECIPITACAO"]
LAG_KEYWORDS = ["TEMPERATURA", "UMIDADE", "PRESSAO"]
ROLLING_KEYWORDS = ["TEMPERATURA", "UMIDADE"]

# role -> (all of these keywords, none of these keywords)
MEASURE_ROLES: dict[str, tuple[list[str], list[str]]] = {
    "rain_mm": (["PRECIPITACAO"], []),
    "temp": (["TEMPERATURA", "BULBO"], []),
    "temp_max": (["TEMPERATURA", "MAX"], ["ORVALHO"]),
    "temp_min": (["TEMPERATURA", "MIN"], ["ORVALHO"]),
    "dew_point": (["ORVALHO"], ["MAX", "MIN"]),
    "dew_max": (["ORVALHO", "MAX"], []),
    "dew_min": (["ORVALHO", "MIN"], []),
    "pressure": (["PRESSAO"], ["MAX", "MIN"]),
    "pressure_max": (["PRESSAO", "MAX"], []),
    "pressure_min": (["PRESSAO", "MIN"], []),
    "humidity": (["UMIDADE RELATIVA"], ["MAX", "MIN"]),
    "humidity_max": (["UMIDADE", "MAX"], []),
    "humidity_min": (["UMIDADE", "MIN"], []),
    "radiation": (["RADIACAO"], []),
    "wind_dir": (["VENTO", "DIRECAO"], []),
    "wind_gust": (["VENTO", "RAJADA"], []),
    "wind_speed": (["VENTO", "VELOCIDADE"], []),
}


def fold(name: str) -> str:
    """Upper-case with accents removed: ``'Pressão máx.'`` -> ``'PRESSAO MAX.'``."""
    decomposed = unicodedata.normalize("NFKD", name)
    return "".join(ch for ch in decomposed if not unicodedata.combining(ch)).upper()


def resolve_time_columns(columns: list[str]) -> dict[str, str]:
    """First column per role whose folded name holds a date / hour keyword.

    Hour candidates whose name contains ``HORARIA`` (hourly measures) are skipped.
    """
    out: dict[str, str] = {}
    for c in columns:
        u = fold(c)
        if "data" not in out and any(k in u for k in DATE_KEYWORDS):
            out["data"] = c
        if "hora" not in out and any(k in u for k in HOUR_KEYWORDS) and HOUR_EXCLUDED_KEYWORD not in u:
            out["hora"] = c
    return out


def resolve_measure_columns(columns: list[str], roles: dict[str, tuple[list[str], list[str]]] | None = None) -> dict[str, str]:
    """role -> first matching column name (accent-insensitive keyword search)."""
    roles = roles or MEASURE_ROLES
    out: dict[str, str] = {}
    for role, (must, must_not) in roles.items():
        for c in columns:
            u = fold(c)
            if all(k in u for k in must) and not any(k in u for k in must_not):
                out[role] = c
                break
    return out


def columns_with_keywords(columns: list[str], keywords: list[str]) -> list[str]:
    """Columns (in order) whose folded name contains any keyword."""
    return [c for c in columns if any(k in fold(c) for k in keywords)]


def feature_diff(before: list[str], after: list[str]) -> list[str]:
    """Columns added by a step, in order (metadata only)."""
    seen = set(before)
    return [c for c in after if c not in seen]


def dedupe(columns: list[str]) -> list[str]:
    seen: set[str] = set()
    return [c for c in columns if not (c in seen or seen.add(c))]
