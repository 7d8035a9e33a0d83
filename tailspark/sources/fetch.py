"""Provider services: requests as rows, answers fetched where the tasks run, records taken from the payloads.

The transport is an argument, so that any client (or a test) can be put in; the default opens
the address with the standard library.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Service addresses, page size, names under which payloads keep their records.
DISCHARGE_URL = "https://waterservices.usgs.gov/nwis/dv/"
CLAIMS_URL = "https://www.fema.gov/api/open/v2/FimaNfipClaims"
PAGE = 5_000
RECORD_KEYS = ("FimaNfipClaims", "fimaNfipClaims", "results", "data")
_TRANSIENT = (429, 500, 502, 503, 504)


def open_text(url: str, timeout: float = 60.0) -> str:
    with urlopen(url, timeout=timeout) as answer:
        return answer.read().decode("utf-8")


def fetch(url: str, opener: Callable[[str], str] = open_text, tries: int = 3, wait: float = 2.0, growth: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer of a service, asked again after transient failures and answers that are no JSON; the last failure is raised."""
    for k in range(tries):
        try:
            text = opener(url)
            json.loads(text)
            return text
        except HTTPError as error:
            if error.code not in _TRANSIENT or k == tries - 1:
                raise
        except (URLError, TimeoutError, json.JSONDecodeError):
            if k == tries - 1:
                raise
        sleep(wait * growth**k)
    raise ValueError("At least one try is needed.")


def discharge_url(site: str, start: str | None = "1980-01-01", end: str | None = None) -> str:
    asked = {"format": "json", "sites": site, "parameterCd": "00060", "statCd": "00003", "siteStatus": "all"}
    asked |= {k: v for k, v in (("startDT", start), ("endDT", end)) if v is not None}
    return f"{DISCHARGE_URL}?{urlencode(asked)}"


def claims_url(state: str, start: str, end: str, skip: int = 0, page: int = PAGE) -> str:
    """Claims of a state with a loss from ``start`` until before ``end``, one page."""
    chosen = f"state eq '{state.upper()}' and dateOfLoss ge '{start}' and dateOfLoss lt '{end}'"
    return f"{CLAIMS_URL}?{urlencode({'$select': 'state,dateOfLoss,amountPaidOnBuildingClaim', '$filter': chosen, '$orderby': 'dateOfLoss', '$skip': skip, '$top': page})}"


def year_windows(spark: SparkSession, states: list[str], start: str, end: str) -> DataFrame:
    """(state, year, from, until): the calendar years of a span, cut to it; one request window each."""
    years = F.explode(F.sequence(F.year(F.lit(start).cast("date")), F.year(F.lit(end).cast("date"))))
    rows = spark.createDataFrame([(s.upper(),) for s in states], "state string").select("state", years.alias("year"))
    first, last = F.make_date("year", F.lit(1), F.lit(1)), F.make_date(F.col("year") + 1, F.lit(1), F.lit(1))
    return rows.select("state", "year", F.greatest(first, F.lit(start).cast("date")).alias("from"), F.least(last, F.date_add(F.lit(end).cast("date"), 1)).alias("until"))


def listed(payload: dict) -> list:
    """The records of a payload: the first list under a known name, else the first list at all."""
    for value in (*(payload.get(k) for k in RECORD_KEYS), *payload.values()):
        if isinstance(value, list):
            return [r for r in value if isinstance(r, dict)]
    raise ValueError("The payload holds no list of records.")


def fetch_claims(windows: DataFrame, opener: Callable[[str], str] = open_text, page: int = PAGE, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Claims of every window, page by page until a short one; windows are fetched in parallel, waits double from 2 s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w in batch.itertuples(index=False):
                skip, more = 0, True
                while more:
                    rows = listed(json.loads(fetch(claims_url(w.state, str(w[2]), str(w[3]), skip, page), opener, 5, 2.0, 2.0, sleep)))
                    yield pd.DataFrame({"state": [r.get("state") for r in rows], "year": w.year, "dateOfLoss": [r.get("dateOfLoss") for r in rows], "amountPaidOnBuildingClaim": [None if r.get("amountPaidOnBuildingClaim") is None else str(r["amountPaidOnBuildingClaim"]) for r in rows]}, dtype=object)
                    skip, more = skip + page, len(rows) == page

    got = windows.mapInPandas(run, "state string, year int, dateOfLoss string, amountPaidOnBuildingClaim string")
    return got.withColumn("dateOfLoss", F.col("dateOfLoss").try_cast("timestamp"))


def records(payload: Column) -> Column:
    """The records of a JSON payload as an array of JSON texts, natively: under the first known name that holds a list, else
    the first value that is one; null where there is none."""
    top = F.from_json(payload, "map<string,string>")
    parsed = lambda v: F.when(F.trim(v).startswith("["), F.from_json(v, "array<string>"))
    known = [parsed(F.try_element_at(top, F.lit(k))) for k in RECORD_KEYS]
    other = F.get(F.filter(F.transform(F.map_values(top), parsed), lambda v: v.isNotNull()), F.lit(0))
    return F.filter(F.coalesce(*known, other), lambda r: F.trim(r).startswith("{"))
