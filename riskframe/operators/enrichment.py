"""Header, address and domain enrichment over tables of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import clamp, col, let
from riskframe.functions.headers import (
    address_part, auth_sender_ip, bracket_value, infrastructure, ip_candidates, ip_class, parse_hop,
)
from riskframe.functions.urls import clean_domain
from riskframe.operators.joins import lookup_join
from riskframe.session import checkpointed

NOT_DETERMINABLE = "ORIGIN_NOT_DETERMINABLE"


def relay_hops(emails: DataFrame, key: str = "email_id", received: str = "received_headers") -> DataFrame:
    """One row per ``Received`` header, earliest hop first. No shuffle."""
    return (
        emails.select(key, F.posexplode(F.reverse(F.col(received))).alias("_pos", "_header"))
        .select(key, (F.col("_pos") + 1).alias("hop_index"), parse_hop("_header").alias("_hop"))
        .select(key, "hop_index", "_hop.*")
    )


def hop_array(received: Column | str) -> Column:
    """The same hops as an array column, for per-message use."""
    return F.transform(F.reverse(col(received)), parse_hop)


def origin_ip(hops: Column, received: Column, headers: Column) -> Column:
    """Earliest public address with the reason it was chosen (``struct<ip, reason>``).

    ``headers`` is a map of lower-cased header names.
    """
    none = F.size(F.coalesce(received, F.array().cast("array<string>"))) == 0

    def aux(name: str) -> Column:
        return let(bracket_value(headers[name]), lambda v: F.when(ip_class(v) == "PUBLIC", F.struct(
            v.alias("ip"),
            F.when(none, f"Identified from {name} header (Received headers absent).")
            .otherwise(f"Cross-checked from authenticated {name} header.").alias("reason"))))

    by_spf = let(auth_sender_ip(headers["authentication-results"]), lambda v: F.when(
        ~none & (ip_class(v) == "PUBLIC"), F.struct(
            v.alias("ip"), F.lit("Extracted from SPF sender IP evaluation in Authentication-Results.").alias("reason"))))

    def first_public(indexed: Column) -> Column:
        return let(F.get(F.filter(indexed, lambda h: h["k"] == "PUBLIC"), F.lit(0)), lambda h: F.when(h.isNotNull(), F.struct(
            h["ip"].alias("ip"),
            F.format_string("Hop %d was the earliest publicly routable IP in the transmission path.", h["n"]).alias("reason"))))

    by_hop = first_public(F.transform(hops, lambda h, i: F.struct(h["ip"].alias("ip"), h["ip_class"].alias("k"), (i + 1).alias("n"))))
    nothing = F.struct(F.lit(NOT_DETERMINABLE).alias("ip"), F.when(
        none, "No Received headers present in email metadata.").otherwise(
        "All observed hops represent private, loopback, or non-routable addresses.").alias("reason"))
    return F.coalesce(by_hop, aux("x-originating-ip"), aux("x-sender-ip"), by_spf, nothing)


def observed_ips(emails: DataFrame, key: str = "email_id") -> DataFrame:
    """Every address of a message with its first sighting, in order of custody.

    Needs ``received_headers`` and the map ``raw_headers``. The de-duplication
    happens inside the row, so nothing is shuffled.
    """
    def source(fragment: Column, header: str, hop: Column) -> Column:
        return F.transform(ip_candidates(fragment), lambda r: F.struct(
            r["ip"].alias("ip"), r["ip_class"].alias("ip_class"), F.lit(header).alias("source_header"),
            hop.cast("int").alias("hop_index")))

    none = F.lit(None).cast("int")
    hops = F.flatten(F.transform(
        F.reverse(F.coalesce(F.col("received_headers"), F.array().cast("array<string>"))),
        lambda h, i: source(address_part(h), "Received", i + 1)))
    aux = [source(F.translate(F.coalesce(F.col("raw_headers")[n], F.lit("")), "[]", "  "), n, none)
           for n in ("x-originating-ip", "x-sender-ip")]
    auth = source(F.coalesce(F.col("raw_headers")["authentication-results"], F.lit("")), "Authentication-Results", none)
    together = emails.select(key, F.concat(hops, *aux, auth).alias("_seen"))
    ips = F.transform(F.col("_seen"), lambda r: r["ip"])
    first = together.withColumn("_ips", ips).select(
        key, F.posexplode(F.filter(
            F.transform(F.col("_seen"), lambda r, i: F.struct(r.alias("r"), (F.array_position(F.col("_ips"), r["ip"]) == i + 1).alias("f"))),
            lambda x: x["f"])).alias("_at", "_x"))
    return first.select(key, (F.col("_at") + 1).alias("sighting"), "_x.r.*")


def resolve_geo(ips: DataFrame, providers: list[DataFrame], key: str = "ip") -> DataFrame:
    """First answer per address over provider snapshots in priority order.

    Each snapshot has ``ip`` and the same record columns.
    """
    ranked = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(providers)]
    stacked = ranked[0]
    for p in ranked[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    record = F.struct(*[c for c in stacked.columns if c not in (key, "_rank")])
    best = stacked.groupBy(key).agg(F.min_by(record, "_rank").alias("_r")).select(key, "_r.*")
    distinct = ips.select(key).distinct().filter(ip_class(key) == "PUBLIC")
    return distinct.join(best, key, "left")


def enrich_hops(hops: DataFrame, geo: DataFrame) -> DataFrame:
    """Geolocation of public hops; every other hop gets an explicit note.

    ``geo`` is unique per ``ip`` and carries ``country, country_code, isp, org,
    lat, lon`` (any further columns pass through).
    """
    known = geo.withColumnsRenamed({c: f"geo_{c}" for c in geo.columns if c != "ip"})
    probe = hops.withColumn("_geo_ip", F.when(F.col("ip_class") == "PUBLIC", F.col("ip")))
    known = known.withColumnRenamed("ip", "_geo_ip").withColumn("_found", F.lit(True))
    joined = lookup_join(probe, known, "_geo_ip")
    note = (
        F.when(F.col("_found"), F.lit("Public routable relay; approximate infrastructure location shown."))
        .when(F.col("ip_class") == "PUBLIC", "Public relay; geolocation lookup unavailable.")
        .when(F.col("ip").isNotNull(), F.concat(
            F.lit("Internal relay ("), F.lower(F.col("ip_class")), F.lit(") — not routable; no geolocation applicable.")))
        .otherwise("No IP address observed in this Received header."))
    return joined.withColumn("note", note).drop("_geo_ip", "_found")


def relay_anomaly(hops: DataFrame, key: str = "email_id", max_ips: int | None = None) -> DataFrame:
    """Contextual anomaly score of a relay path (never part of the verdict).

    Works on the distinct resolved public addresses of each message in hop
    order; ``max_ips`` limits it to the first addresses (off by default).
    """
    public = (
        hops.filter((F.col("ip_class") == "PUBLIC") & F.col("geo_country_code").isNotNull())
        .groupBy(key, "ip").agg(
            F.min("hop_index").alias("hop_index"),
            F.first("geo_country_code").alias("code"), F.first("geo_org").alias("org")))
    if max_ips is not None:
        from riskframe.operators.joins import top_n
        public = top_n(public, [key], [F.col("hop_index"), F.col("ip")], max_ips).drop("rank")
    kind = infrastructure(F.col("ip"), F.col("org"))
    hidden = kind.isin("VPN_PROXY", "TOR_EXIT")
    scored = public.withColumns({"_risky": F.col("code").isin(lx.HIGH_RISK_COUNTRIES), "_hidden": hidden,
                                 "_cloud": kind.isin("DATACENTER_CLOUD", "HOSTING_PROVIDER")})
    grouped = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("relay_count"),
        F.countDistinct("code").alias("country_count"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("countries"),
        F.sum(F.when(F.col("_risky"), 25).otherwise(0) + F.when(F.col("_hidden"), 20).otherwise(0)).alias("_points"),
        F.count_if(F.col("_risky")).alias("high_risk_hops"), F.count_if(F.col("_hidden")).alias("hidden_hops"),
        F.count_if(F.col("_cloud")).alias("cloud_hops"))
    score = clamp(F.col("_points") + F.when(F.col("country_count") > 3, 20).otherwise(0)).cast("int")
    return grouped.withColumn("anomaly_score", score).drop("_points")


def plottable_hops(hops: DataFrame) -> DataFrame:
    lat, lon = F.col("geo_lat"), F.col("geo_lon")
    return hops.filter(
        F.upper(F.col("ip_class")).contains("PUBLIC") & lat.isNotNull() & lon.isNotNull() & (lat != 0.0) & (lon != 0.0)
        & lat.between(-90, 90) & lon.between(-180, 180))


def enrich_domains(emails: DataFrame, dim: DataFrame, as_of: Column, sender: str = "sender",
                   url_domain: str = "url_domain") -> DataFrame:
    """Attach registration facts of the sender domain and of the first link.

    ``dim`` is unique per ``domain`` with ``creation_date, registrar, has_mx``.
    ``as_of`` fixes the day ages are counted to.
    """
    facts = dim.select(
        "domain", "registrar", "creation_date", "has_mx",
        F.when(F.col("creation_date").isNotNull(), F.greatest(F.datediff(as_of, F.col("creation_date")), F.lit(0))).alias("age_days"),
        F.when(F.col("has_mx") | F.col("registrar").isNotNull(), "RESOLVED").otherwise("PARTIAL_OR_UNAVAILABLE").alias("domain_status"))
    out = emails.withColumn("domain", clean_domain(sender))
    out = lookup_join(out, facts, "domain").withColumn("is_young_domain", F.coalesce(F.col("age_days") < 30, F.lit(False)))
    if url_domain in emails.columns:
        link = facts.select(F.col("domain").alias(url_domain), F.col("age_days").alias("url_age_days"))
        out = lookup_join(out, link, url_domain)
    return out


def parse_registry(c: Column | str, as_of: Column) -> Column:
    """Registration date, age and registrar out of a registry JSON document."""
    schema = ("events array<struct<eventAction:string,eventDate:string>>, entities array<struct<"
              "roles:array<string>,handle:string,vcardArray:array<string>>>")
    doc = F.from_json(col(c), schema)
    events = F.coalesce(doc["events"], F.array().cast("array<struct<eventAction:string,eventDate:string>>"))
    dated = lambda name: F.element_at(F.filter(events, lambda e: e["eventAction"] == name), -1)["eventDate"]
    has = lambda name: F.exists(events, lambda e: e["eventAction"] == name)
    stamp = F.coalesce(F.when(has("registration"), dated("registration")), F.when(has("transfer"), dated("transfer")))
    day = F.split_part(stamp, F.lit("T"), F.lit(1))
    created = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date"))
    registrars = F.filter(doc["entities"], lambda e: F.array_contains(e["roles"], "registrar"))
    registrar = F.get(registrars, F.lit(0))
    name = F.regexp_extract(F.coalesce(F.get(registrar["vcardArray"], F.lit(1)), F.lit("")),
                            r'\["fn",[^\]]*?,"text","([^"]*)"\]', 1)
    return F.struct(
        F.coalesce(created.cast("string"), F.substring(stamp, 1, 10)).alias("creation_date"),
        F.when(created.isNotNull(), F.greatest(F.datediff(as_of, created), F.lit(0))).alias("age_days"),
        F.coalesce(F.when(name != "", name), F.when(registrar["handle"] != "", registrar["handle"]),
                   F.lit("Private / Unlisted")).alias("registrar"))


def decode_hosts(df: DataFrame, host: str = "host", out: str = "unicode_host") -> DataFrame:
    """Unicode form of IDN hosts.

    Only distinct ``xn--`` hosts go through Python, in Arrow batches.
    """
    idn = df.filter(F.col(host).contains("xn--")).select(host).distinct()

    def decode(batches):
        def one(name):
            labels = []
            for label in name.split("."):
                try:
                    labels.append(label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label)
                except (UnicodeError, ValueError):
                    labels.append(label)
            return ".".join(labels)

        for pdf in batches:
            pdf[out] = [one(n) for n in pdf[host]]
            yield pdf[[host, out]]

    decoded = idn.mapInPandas(decode, f"{host} string, {out} string")
    return df.join(decoded, host, "left").withColumn(out, F.coalesce(F.col(out), F.col(host)))


def spoofed_links(messages: DataFrame, key: str, urls: str = "urls") -> DataFrame:
    """``typosquat`` and ``homograph`` of a message: whether one of its links imitates a brand.

    Distinct hosts are decoded (IDN) and judged once each, and their few positives joined back.
    """
    from riskframe.functions.common import host_of
    from riskframe.functions.urls import domain_spoof

    links = messages.select(key, F.explode(F.array_distinct(F.transform(urls, host_of))).alias("host"))
    hosts = decode_hosts(links.select("host").distinct())
    judged = hosts.select("host", domain_spoof(F.col("host"), F.col("unicode_host")).alias("s")).filter("s.typosquat or s.homograph")
    found = lookup_join(links, checkpointed(judged), "host", "inner").groupBy(key).agg(
        F.bool_or("s.typosquat").alias("typosquat"), F.bool_or("s.homograph").alias("homograph"))
    return lookup_join(messages, found, key).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("typosquat", "homograph")})


def known_bad_attachments(attachments: DataFrame, hashes: DataFrame) -> DataFrame:
    """Attachments whose digest is on the list; the digest of empty input never counts."""
    listed = hashes.select(F.lower(F.col("sha256")).alias("sha256")).filter(F.col("sha256") != lx.EMPTY_SHA256).distinct()
    return lookup_join(attachments.withColumn("sha256", F.lower("sha256")), listed, "sha256", "left_semi")


def attachment_risk(df: DataFrame) -> DataFrame:
    """Checks per attachment; needs ``filename, content_type, sha256, is_encrypted, known_bad``."""
    from riskframe.functions.common import compact, ends_with_any

    name = F.lower(F.coalesce(F.col("filename"), F.lit("")))
    mime = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    encrypted = F.coalesce(F.col("is_encrypted"), F.lit(False))
    bad = F.coalesce(F.col("known_bad"), F.lit(False))
    mismatch = name.endswith(".pdf") & (mime != "") & ~mime.contains("pdf") & ~mime.contains("octet-stream")
    dangerous = ends_with_any(name, lx.DANGEROUS_ATTACHMENTS)
    return df.withColumns({
        "attachment_score": F.greatest(
            F.when(encrypted, 75).otherwise(0), F.when(bad, 100).otherwise(0),
            F.when(mismatch, 85).otherwise(0), F.when(dangerous, 90).otherwise(0)),
        "is_malware": dangerous | bad,
        "attachment_factors": compact(
            F.when(encrypted, F.concat(F.lit("Password-protected attachment detected: '"), F.col("filename"),
                                       F.lit("' (elevated risk — uninspectable)"))),
            F.when(bad, F.concat(F.lit("Malicious attachment detected by SHA-256 threat DB: "),
                                 F.substring(F.lower("sha256"), 1, 12), F.lit("..."))),
            F.when(mismatch, F.concat(F.lit("MIME-type mismatch: '"), name, F.lit("' claims to be PDF but MIME is '"), mime, F.lit("'"))),
            F.when(dangerous, F.concat(F.lit("Dangerous attachment extension: "), F.col("filename")))),
    })


def trusted_hosts(hosts: DataFrame, dim: DataFrame, host: str = "host") -> DataFrame:
    """Suffix match of hosts against a trust list of any size, as an equi-join."""
    from riskframe.functions.urls import host_suffixes

    pairs = hosts.select(host).distinct().withColumn("domain", F.explode(host_suffixes(F.col(host))))
    found = lookup_join(pairs, dim.select("domain").distinct(), "domain", "left_semi").select(host).distinct()
    return hosts.join(found.withColumn("is_trusted", F.lit(True)), host, "left").withColumn(
        "is_trusted", F.coalesce(F.col("is_trusted"), F.lit(False)))
