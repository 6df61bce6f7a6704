"""Driver-side ends of the pipeline: compose loop, preview, actions, reports."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from galley.functions.predicates import html_problems, repaired_html


def composed(pages: DataFrame, key: str, rounds: int = 3) -> DataFrame:
    """``key``, html, problems: each page gated and repaired up to ``rounds`` - 1 times; problems are those left."""
    x = pages.select(key, F.coalesce("html", F.lit("")).alias("html")).withColumn("problems", html_problems(F.col("html")))
    for _ in range(rounds - 1):
        fixed = F.when(F.size("problems") > 0, repaired_html(F.col("html"), F.col("problems"))).otherwise(F.col("html"))
        x = x.select(key, fixed.alias("html")).withColumn("problems", html_problems(F.col("html")))
    return x


def send_actions(pages: DataFrame, subject: Column, sender: str, to: str) -> DataFrame:
    """One action per page that is whole; a blank subject, sender, receiver or body is an error, not a mail."""
    wrong = F.array_compact(F.array(F.when(F.trim(F.coalesce(subject, F.lit(""))) == "", "subject"), F.when(F.lit(not sender.strip()), "sender"), F.when(F.lit(not to.strip()), "to"), F.when(F.trim(F.coalesce("html", F.lit(""))) == "", "html")))
    return pages.withColumn("subject", subject).withColumn("sender", F.lit(sender)).withColumn("to", F.lit(to)).withColumn("missing", wrong)


def encoded_mail(sender: str, to: str, subject: str, html: str, plain: str | None = None) -> str:
    """A mail of several parts in base64url: the plain text first where there is one, then the page."""
    for name, value in (("subject", subject), ("to", to), ("sender", sender), ("html", html)):
        if not (value or "").strip():
            raise ValueError(f"{name} is missing")
    mail = MIMEMultipart("alternative")
    for header, value in (("From", sender), ("To", to), ("Subject", subject)):
        mail[header] = value
    for body, kind in ((plain, "plain"), (html, "html")):
        if body:
            mail.attach(MIMEText(body, kind, "utf-8"))
    return base64.urlsafe_b64encode(mail.as_bytes()).decode("ascii")


@F.pandas_udf(StringType())
def raw_mail(sender: pd.Series, to: pd.Series, subject: pd.Series, html: pd.Series) -> pd.Series:
    """``encoded_mail`` of every row of whole actions; null where something is missing."""
    rows = zip(sender, to, subject, html, strict=True)
    return pd.Series([encoded_mail(*r) if all((x or "").strip() for x in r) else None for r in rows], dtype=object)


def sent(actions: DataFrame, key: str, send: Callable[[str], dict]) -> DataFrame:
    """``key``, message_id and error of every action with a ``raw`` mail: a response without an id is an error, as is a sender that raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for raw in f["raw"]:
                try:
                    answer = send(raw)
                    out.append((str(answer["id"]), None) if "id" in answer else (None, "the response has no id"))
                except Exception as e:  # the row's error, not the job's
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({key: f[key], "message_id": [o[0] for o in out], "error": [o[1] for o in out]})

    slim = actions.where("raw is not null").select(key, "raw")
    return slim.mapInPandas(run, f"{key} {dict(slim.dtypes)[key]}, message_id string, error string")


def preview(digest: DataFrame, out: str | Path | None = None, write: Callable[[str], object] = print) -> int:
    """Writes the page of the one digest to a file, or prints it; 1 where there is none or it is blank."""
    row = digest.select("body_html").limit(1).collect()
    html = row[0][0] if row else None
    if not (html or "").strip():
        return 1
    if out is None:
        write(html)
    else:
        Path(out).write_text(html, encoding="utf-8")
    return 0


def audit_report(audited: DataFrame) -> DataFrame:
    """email_id and a text report of its sections: disposition, rule, size and preview, in order."""
    line = F.concat_ws(" | ", "section_key", "disposition", "rule", F.col("n_chars").cast("string"), F.regexp_replace("preview", r"\s+", " "))
    per = audited.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("l")))).alias("s"))
    return per.select("email_id", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("report"))
