"""Evidence from a record's web page: JSON-LD, table cells, heading."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

EVIDENCE = StructType().add("name", StringType()).add("address", StringType()).add("phone", StringType()).add("relocated", BooleanType()).add("records", IntegerType())


def _flat(value):
    """All objects in nested lists and @graph members."""
    if isinstance(value, list):
        for v in value:
            yield from _flat(v)
    elif isinstance(value, dict):
        yield value
        if "@graph" in value:
            yield from _flat(value["@graph"])


@F.pandas_udf(EVIDENCE)
def evidence_of(pages: pd.Series) -> pd.DataFrame:
    import html
    import json
    import re

    def clean(s):
        return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", s))).strip() or None

    def one(page):
        page = page or ""
        found = []
        for block in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", page, re.S | re.I):
            try:
                found += [x for x in _flat(json.loads(block)) if x.get("name") and x.get("address")]
            except ValueError:
                continue
        cells = {clean(k): clean(v) for k, v in re.findall(r"<th[^>]*>(.*?)</th>\s*<td[^>]*>(.*?)</td>", page, re.S | re.I)}
        name = address = phone = None
        if len(found) == 1:  # several records on a page say nothing certain
            address = found[0]["address"]
            address = "".join(str(address.get(k) or "") for k in ("addressRegion", "addressLocality", "streetAddress")) if isinstance(address, dict) else str(address)
            name, phone = str(found[0]["name"]), found[0].get("telephone")
        heading = re.search(r"<h1[^>]*>(.*?)</h1>", page, re.S | re.I)
        name = name or cells.get("店名") or (clean(heading.group(1)) if heading else None)
        address = address or cells.get("住所")
        phone = phone or cells.get("電話番号") or cells.get("TEL")
        return name, address, phone, bool(re.search("移転|relocated", clean(page) or "")), len(found)

    return pd.DataFrame([one(p) for p in pages], columns=EVIDENCE.fieldNames())


def evidence(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Pages with what they say of their record."""
    return pages.withColumn("evidence", evidence_of(F.col(html_col)))
