"""Classes of fetch errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stable classes of a failed fetch, and the HTTP codes of a refused login.
TIMEOUT, AUTH, HTTP, PARSE = "source_timeout", "source_auth_error", "source_http_error", "source_parse_error"
REFUSED = (401, 403)


def fetch_error(kind: Column, status: Column) -> Column:
    """The class of a failed attempt from what was logged: ``kind`` (``timeout``, ``status`` for an answer with an error code,
    ``transport`` for any other failure of the connection; all else failed while reading the answer) and the HTTP ``status``.
    A null kind is no failure."""
    answered = F.when(status.isin(*REFUSED), AUTH).otherwise(HTTP)
    return F.when(kind.isNull(), F.lit(None).cast("string")).when(kind == "timeout", TIMEOUT).when(kind == "status", answered).when(kind == "transport", HTTP).otherwise(PARSE)
