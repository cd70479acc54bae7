"""Captured responses in place of live requests: which give a document, and why others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.plans.lineage import cut

# Kinds of content, limits, redirect answers.
PAGE_MIMES = ("text/html", "application/xhtml+xml", "text/plain", "text/markdown")
TEXT_MIMES = (*PAGE_MIMES, "application/xml", "text/xml", "application/gzip", "application/x-gzip")
HTML_MIMES = ("text/html", "application/xhtml+xml")
MAX_BODY_BYTES, MAX_AUXILIARY_BYTES = 2_000_000, 256_000
MAX_REDIRECTS = 5
REDIRECTS = (301, 302, 303, 307, 308)
# Messages of the errors.
NO_TRANSPORT = "HTTP transport failed."
NO_LOCATION = "Redirect is missing Location."
DOWNGRADE = "HTTPS downgrade refused."
BAD_MIME = "Response content type is not supported."
LARGE_BODY = "Response exceeds the body size limit."
INVALID_URL = "Expected a public HTTP(S) URL on port 80 or 443 without credentials."
LOOP, TOO_MANY = "Redirect loop detected.", "Redirect limit reached."
OFF_HOST = "URL is outside the starting hostname."
LOCAL_HOST = "Local hostnames are not allowed."
NOT_PUBLIC = "Every resolved destination must be a public address."


def error(code: str | Column, message: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(code).alias("code"), lit(message).alias("message"))


def mime_type(mime: Column) -> Column:
    """The type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))


def latest(snapshot: DataFrame) -> DataFrame:
    """Of the captures of one url, the last one."""
    best = snapshot.groupBy("url").agg(F.max(F.struct("captured_at", "capture_id")).alias("b")).select(F.col("b.capture_id").alias("capture_id"))
    return snapshot.join(best, "capture_id", "left_semi")


def classify(snapshot: DataFrame, mimes: tuple[str, ...] = PAGE_MIMES, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """Adds ``mime_type``, ``outcome`` (document, redirect, failed) and ``error`` to captured responses.

    A null status is a failed transport; a null body is an empty one.
    """
    status, mime = F.col("status"), mime_type(F.col("mime"))
    moved = status.isin(*REDIRECTS)
    why = (
        F.when(status.isNull(), error("network_error", NO_TRANSPORT))
        .when(moved & (F.coalesce(F.col("redirect_location"), F.lit("")) == ""), error("invalid_redirect", NO_LOCATION))
        .when(status >= 500, error("http_5xx", F.format_string("HTTP %d response.", status)))
        .when(status >= 400, error(F.format_string("http_%d", status), F.format_string("HTTP %d response.", status)))
        .when(~moved & ~status.between(200, 299), error("http_unexpected", F.format_string("Unexpected HTTP %d.", status)))
        .when(~moved & ~mime.isin(*mimes), error("unsupported_mime", BAD_MIME))
        .when(~moved & (F.coalesce(F.octet_length("body"), F.lit(0)) > limit), error("too_large", LARGE_BODY))
    )
    df = snapshot.withColumns({"mime_type": mime, "error": why})
    return df.withColumn("outcome", F.when(F.col("error").isNotNull(), "failed").when(moved, "redirect").otherwise("document"))


def host_policy(url: Column, start_host: Column, ips: Column) -> Column:
    """The error that the network policy raises for a normalized url; null where it is allowed."""
    host = urls.host(url)
    return (
        F.when(url.isNull(), error("invalid_url", INVALID_URL))
        .when(host != start_host, error("off_host", OFF_HOST))
        .when(urls.is_local_host(host), error("blocked_by_ssrf_policy", LOCAL_HOST))
        .when(~urls.all_public(ips), error("blocked_by_ssrf_policy", NOT_PUBLIC))
    )


def resolve(requests: DataFrame, responses: DataFrame, public_only: bool = True) -> DataFrame:
    """Follow each of ``requests`` (url, start_host) through ``responses`` (classified, one per normalized ``url``).

    Gives url, start_host, final_url, error, http_status, mime_type, body. At
    most 5 redirects are followed, each by one join of the urls still moving.
    """
    if public_only:
        policy = F.when(~urls.all_public(F.col("resolved_ips")), error("blocked_by_ssrf_policy", NOT_PUBLIC))
    else:
        policy = F.lit(None).cast("struct<code:string,message:string>")
    known = responses.select(F.col("url").alias("at"), "status", "mime_type", "error", "outcome", "redirect_location", policy.alias("blocked"))
    target = urls.normalize_url(F.col("redirect_location"), F.col("at"))
    moves = known.withColumn("next", F.when(F.col("outcome") == "redirect", target)).drop("redirect_location")
    todo = requests.select("url", "start_host", F.col("url").alias("at"), F.array().cast("array<string>").alias("path")).distinct()
    done = None
    for hop in range(MAX_REDIRECTS + 1):
        host = urls.host(F.col("at"))
        seen = todo.join(moves, "at", "left")
        why = (
            F.when(host != F.col("start_host"), error("off_host", OFF_HOST))
            .when(urls.is_local_host(host), error("blocked_by_ssrf_policy", LOCAL_HOST))
            .when(F.array_contains("path", F.col("at")), error("redirect_loop", LOOP))
            .when(F.col("outcome").isNull(), error("network_error", NO_TRANSPORT))
            .when(F.col("blocked").isNotNull(), F.col("blocked"))
            .when(F.col("error").isNotNull(), F.col("error"))
            .when((F.col("outcome") == "redirect") & F.col("next").isNull(), error("invalid_url", INVALID_URL))
            .when(F.col("at").startswith("https:") & F.col("next").startswith("http:"), error("unsafe_redirect", DOWNGRADE))
        )
        if hop == MAX_REDIRECTS:
            why = F.coalesce(why, F.when(F.col("outcome") == "redirect", error("too_many_redirects", TOO_MANY)))
        seen = cut(seen.withColumn("why", why))
        over = seen.where("why is not null or outcome = 'document'").select("url", "start_host", F.col("at").alias("final_url"), F.col("why").alias("error"), F.col("status").alias("http_status"), "mime_type")
        done = over if done is None else done.unionByName(over)
        todo = seen.where("why is null and outcome = 'redirect'").select("url", "start_host", F.col("next").alias("at"), F.concat("path", F.array("at")).alias("path"))
        if todo.isEmpty():
            break
    bodies = responses.where("outcome = 'document'").select(F.col("url").alias("final_url"), "body")
    return done.join(bodies, "final_url", "left")


def text_files(starts: DataFrame, responses: DataFrame, names: tuple[str, ...] = ("llms.txt", "llms-full.txt"), public_only: bool = True) -> DataFrame:
    """(start_url, name, present, status, error): whether each site offers the files that describe it to models, redirects followed."""
    root = F.concat(F.try_parse_url("start_url", F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url("start_url", F.lit("AUTHORITY")), F.lit("/"))
    asked = starts.select("start_url", F.explode(F.array(*[F.lit(n) for n in names])).alias("name")).withColumn("url", F.concat(root, F.col("name")))
    found = resolve(asked.select("url", urls.host(F.col("url")).alias("start_host")), responses, public_only).drop("start_host")
    code = F.coalesce("error.code", F.when(~F.col("mime_type").isin(*PAGE_MIMES), "unsupported_mime"), F.when(F.octet_length("body") > MAX_AUXILIARY_BYTES, "too_large"))
    got = asked.join(found.select("url", "http_status", "mime_type", code.alias("code"), F.coalesce(F.decode("body", "UTF-8"), F.lit("")).alias("text")), "url")
    page = F.col("mime_type").isin(*HTML_MIMES) | F.contains(F.lower("text"), F.lit("<html"))
    fine = F.col("code").isNull()
    return got.select(
        "start_url", "name", F.when(fine, (F.trim("text") != "") & ~page).when(F.col("http_status").isin(404, 410), False).alias("present"),
        F.col("http_status").alias("status"), F.when(fine & page, "html_response").when(~fine, F.col("code")).alias("error"),
    )
