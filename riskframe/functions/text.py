"""Text rules: extraction, redaction, signal groups, language and context guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import lexicons as lx
from riskframe.functions.common import (
    any_of, col, compact, contains_any, flag, hit_count, hits, host_of, strip, text, words,
)

URL_PATTERN = r"""(?i)https?://[^\s<>"')\]},;]+"""
MESSAGE_URL_PATTERN = r"""(?i)https?://[^\s<>"']+"""
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4_URL_PATTERN = rf"(?i)^(?:https?://)?(?:{_OCTET}\.){{3}}{_OCTET}(?::\d{{1,5}})?(?:/\S*)?$"


# -- extraction ------------------------------------------------------------

def extract_urls(c: Column | str) -> Column:
    """URLs in order of first sight, closing dots removed."""
    found = F.regexp_extract_all(text(c), F.lit(URL_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit("."))))


def extract_message_urls(c: Column | str) -> Column:
    """The looser variant used on short messages."""
    found = F.regexp_extract_all(text(c), F.lit(MESSAGE_URL_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,;"))))


def _looks_like_url(token: Column) -> Column:
    clean = F.ltrim(token, F.lit("(\"'"))
    lower = F.lower(clean)
    scheme = lower.startswith("http://") | lower.startswith("https://")
    extension = F.when(lower.contains("."), F.substring_index(lower, ".", -1)).otherwise("")
    head = F.substring_index(lower, "/", 1)
    tld = F.when(head.contains("."), F.substring_index(head, ".", -1)).otherwise("")
    address = clean.rlike(IPV4_URL_PATTERN)
    version = lower.rlike(r"^\d{1,2}\.\d{1,2}(\.\d{1,2})?$") & ~address
    bare = clean.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}(?:/\S*)?$") & tld.isin(lx.VALID_TLDS)
    return (
        (strip(clean) != "") & ~clean.contains("@")
        & (~clean.contains(":") | scheme | clean.rlike(r"^.*:\d{2,5}(/.*)?$"))
        & ~lower.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") & ~version
        & ~lower.isin(lx.ABBREVIATIONS) & ~extension.isin(lx.NON_URL_EXTENSIONS)
        & (clean.rlike(r"(?i)^(https?://\S+|www\.\S+)$") | address | bare)
    )


def extract_screen_urls(c: Column | str) -> Column:
    """Whitespace tokens that read as a web address (scheme, www, IPv4 or known TLD)."""
    tokens = F.transform(F.split(text(c), r"\s+"), lambda t: F.rtrim(t, F.lit(".,;!?)\"'•-")))
    return F.array_distinct(F.filter(tokens, _looks_like_url))


def extract_phones(c: Column | str) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(PHONE_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, strip))


def extract_emails(c: Column | str) -> Column:
    found = F.regexp_extract_all(text(c), F.lit(EMAIL_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def merge_urls(a: Column, b: Column) -> Column:
    """Union of two evidence sources, only openable schemes."""
    return F.filter(F.array_union(a, b), lambda u: F.lower(u).rlike("^(https?|upi)://"))


def link_mismatches(html: Column | str) -> Column:
    """Anchors whose visible text is a URL of another host than the target."""
    anchor = r"""(?is)<a[^>]+href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    body = text(html)
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(anchor), F.lit(1)).alias("href"),
        F.regexp_extract_all(body, F.lit(anchor), F.lit(2)).alias("shown"),
    )

    def differs(p: Column) -> Column:
        shown = strip(F.regexp_replace(p["shown"], "<[^>]+>", ""))
        target, claimed = host_of(p["href"]), host_of(shown)
        return shown.rlike("(?i)^https?://") & (target != claimed) & (target != "") & (claimed != "")

    return F.size(F.filter(pairs, differs))


# -- redaction -------------------------------------------------------------

def redact_pii(c: Column | str) -> Column:
    """Mask e-mail users, phones, cards and SSNs, in that order."""
    out = text(c)
    for pattern, mask in [
        (r"\b([A-Za-z0-9._%+-]{1})[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "$1***@$2"),
        (r"\b(?:\+\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b", "[REDACTED_PHONE]"),
        (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "[REDACTED_CARD]"),
        (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ]:
        out = F.regexp_replace(out, pattern, mask)
    return out


def redact_codes(c: Column | str) -> Column:
    """Mask one-time codes and explicit secret assignments."""
    out = F.regexp_replace(text(c), r"\b\d{4,8}\b", "[REDACTED_OTP]")
    return F.regexp_replace(out, r"(?i)(password|pin|cvv|code)\s*[:=]\s*\S+", "$1: [REDACTED]")


def redact_contact(c: Column | str) -> Column:
    """Mask e-mail addresses, phones and payment handles."""
    out = F.regexp_replace(text(c), EMAIL_PATTERN, "[REDACTED_EMAIL]")
    out = F.regexp_replace(out, PHONE_PATTERN, "[REDACTED_PHONE]")
    return F.regexp_replace(out, r"(?i)\b[a-zA-Z0-9.\-_]{2,256}@[a-zA-Z]{2,64}\b", "[REDACTED_UPI]")


def mask_email(c: Column | str) -> Column:
    """First character, three stars, domain; text without ``@`` stays as it is."""
    value = col(c)
    user, domain = F.split_part(value, F.lit("@"), F.lit(1)), F.split_part(value, F.lit("@"), F.lit(2))
    short = F.when(F.length(user) > 1, F.concat(F.substring(user, 1, 1), F.lit("***"))).otherwise("***")
    return F.when(value.contains("@"), F.concat(short, F.lit("@"), domain)).otherwise(value)


# -- normalisation ---------------------------------------------------------

def normalize_sender(c: Column | str) -> Column:
    value = strip(text(c))
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(value.contains("@"), F.lower(value))
        .when(F.length(digits) >= 10, F.right(digits, F.lit(10)))
        .otherwise(F.lower(value))
    )


def normalize_indicator(kind: Column, value: Column | str) -> Column:
    base = F.lower(strip(text(value)))
    address = F.regexp_extract(base, r"<([^<>]+)>", 1)
    mailbox = F.when(address != "", strip(address)).otherwise(base)
    tail = F.substring_index(base, "@", -1)
    host = F.when(tail.rlike("^https?://"), host_of(tail)).otherwise(tail)
    domain = F.btrim(strip(host), F.lit("/"))
    return (
        F.when(kind.isin("sender_email", "reply_to"), mailbox)
        .when(kind.isin("sender_domain", "url_domain"), domain)
        .otherwise(base)
    )


def normalize_adversarial(c: Column | str) -> Column:
    """Undo leetspeak, letter spacing and stretched letters."""
    out = F.translate(F.lower(text(c)), lx.LEET_FROM, lx.LEET_TO)
    for n in (4, 3, 2):
        pattern = r"\b" + r"\s+".join(["([a-z])"] * n) + r"\b"
        out = F.regexp_replace(out, pattern, "".join(f"${i}" for i in range(1, n + 1)))
    return F.regexp_replace(out, r"([a-z])\1{2,}", "$1$1")


def clean_for_model(c: Column | str) -> Column:
    lower = F.regexp_replace(F.lower(text(c)), r"http\S+", "<url>")
    return strip(F.regexp_replace(lower, r"[^a-z0-9\s<>\x{0B80}-\x{0BFF}]", ""))


def valid_case_id(c: Column | str) -> Column:
    return col(c).rlike("^[A-Za-z0-9_-]{3,64}$")


def evidence_hash(sender: Column | str, subject: Column | str, ts: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", text(sender), text(subject), text(ts)), 256)


# -- gates -----------------------------------------------------------------

def analysable(c: Column | str) -> Column:
    value = strip(text(c))
    return (F.length(value) >= 30) & ~contains_any(F.lower(value), lx.UI_NOISE_TERMS)


def meaningful(c: Column | str) -> Column:
    value = strip(text(c))
    return (F.length(value) >= 15) & (F.size(words(value)) >= 3)


# -- signal groups ---------------------------------------------------------

def text_signals(c: Column | str) -> Column:
    """Five independent textual scam signals with their corroboration level."""
    value = text(c)
    credential = (
        value.rlike(lx.CREDENTIAL_REQUEST_PATTERN)
        & ~value.rlike(lx.SAFETY_ADVICE_PATTERN) & ~value.rlike(lx.INFORMATIONAL_PATTERN)
    )
    return F.struct(
        value.rlike(lx.URGENCY_PATTERN).alias("urgency"),
        value.rlike(lx.ACTION_PATTERN).alias("action"),
        credential.alias("credential"),
        value.rlike(lx.MONEY_LURE_PATTERN).alias("money_lure"),
        value.rlike(lx.CALLBACK_PATTERN).alias("callback"),
    )


def signal_count(signals: Column) -> Column:
    names = ["urgency", "action", "credential", "money_lure", "callback"]
    total = F.lit(0)
    for name in names:
        total = total + signals[name].cast("int")
    return total


def signal_confidence(count: Column) -> Column:
    return F.when(count >= 3, "HIGH").when(count == 2, "MEDIUM").otherwise("LOW")


def phrase_hits(c: Column, kind: str) -> Column:
    return hits(c, lx.PHRASE_LISTS[kind])


def exposure_findings(c: Column | str) -> Column:
    """Exposed secrets as ``array<struct<type, masked>>``; only the masked text leaves."""
    value = text(c)

    def findings(label: str, pattern: str) -> Column:
        found = F.regexp_extract_all(value, F.lit("(?i)" + pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(
            F.lit(label).alias("type"),
            F.regexp_replace(m, r"([:=]\s*)(\S{2})(\S+)", "$1$2***").alias("masked")))

    return F.concat(*[findings(label, pattern) for label, pattern in lx.EXPOSURE_PATTERNS])


def exposed_types(c: Column | str) -> Column:
    """Labels of the exposure rules that match, without building the matches."""
    value = text(c)
    # A literal every match must contain keeps most texts away from the pattern.
    needed = {"email:password credential pair": "@", "private key block": "-----"}
    test = lambda label, p: value.contains(needed[label]) & value.rlike("(?i)" + p) if label in needed else value.rlike("(?i)" + p)
    return compact(*[F.when(test(label, p), F.lit(label)) for label, p in lx.EXPOSURE_PATTERNS])


# -- forwarded mail --------------------------------------------------------

FORWARD_SUBJECT = r"(?i)^(?:fwd?|fw):\s*"
FORWARD_MARKERS = [
    r"(?i)-+\s*Forwarded message\s*-+", r"(?i)-+\s*Original Message\s*-+",
    r"(?i)Begin forwarded message:?",
]
FORWARD_BLOCK = r"(?i)(?:^|\n)\s*From:\s*[^\n]+\n\s*Date:\s*[^\n]+"


def _header_line(name: str, c: Column) -> Column:
    value = strip(F.regexp_extract(c, rf"(?i){name}:\s*([^\n]+)", 1))
    return F.when(value != "", value)


def forwarding(body: Column | str, subject: Column | str) -> Column:
    """Forwarding evidence of a message, over its whole text."""
    text_body, is_fwd = text(body), text(subject).rlike(FORWARD_SUBJECT)
    at_marker = F.coalesce(*[
        F.when(text_body.rlike(p), F.split(text_body, p, 2)) for p in FORWARD_MARKERS])
    block_at = F.when(is_fwd, F.regexp_instr(text_body, F.lit(FORWARD_BLOCK)))
    marked, blocked = at_marker.isNotNull(), F.coalesce(block_at > 0, F.lit(False))
    whole = strip(text_body)
    original = (
        F.when(marked, strip(at_marker[1]))
        .when(blocked, strip(F.substring(text_body, block_at, F.length(text_body))))
        .otherwise(whole)
    )
    comment = (
        F.when(marked, strip(at_marker[0]))
        .when(blocked, strip(F.substring(text_body, F.lit(1), block_at - 1)))
        .when(is_fwd, whole).otherwise("")
    )
    quoted = marked | blocked
    sender = F.when(quoted, _header_line("From", original))
    level = (
        F.when(quoted & sender.contains("@"), "ORIGINAL HEADER EVIDENCE AVAILABLE")
        .when(quoted, "PARTIAL ORIGINAL EVIDENCE")
        .when(is_fwd, "FORWARDER-ONLY EVIDENCE")
        .otherwise("ORIGINAL SOURCE UNDETERMINABLE")
    )
    return F.struct(
        (quoted | is_fwd).alias("is_forwarded"), level.alias("evidence_level"),
        sender.alias("original_sender"),
        F.when(quoted, _header_line("Date", original)).alias("original_date"),
        F.when(quoted, _header_line("Subject", original)).alias("original_subject"),
        comment.alias("forwarder_commentary"), original.alias("original_content"),
    )


def forwarded_by_header(headers: Column) -> Column:
    """Transport-header evidence in a map of lower-cased header names."""
    return F.coalesce(F.exists(
        F.map_keys(headers), lambda k: (F.lower(k) == "x-forwarded-for") | F.lower(k).startswith("resent-")),
        F.lit(False))


# -- language --------------------------------------------------------------

def has_tamil(c: Column | str) -> Column:
    return text(c).rlike(r"[\x{0B80}-\x{0BFF}]")


def has_devanagari(c: Column | str) -> Column:
    return text(c).rlike(r"[\x{0900}-\x{097F}]")


def has_telugu(c: Column | str) -> Column:
    return text(c).rlike(r"[\x{0C00}-\x{0C7F}]")


def pattern_hits(c: Column, patterns: list[tuple[str, str]]) -> Column:
    return compact(*[F.when(c.rlike(p), F.lit(name)) for name, p in patterns])


def latin_tokens(normalized: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit("[a-z]+"), F.lit(0)))


def fuzzy_distance(word: str) -> int:
    return 1 if len(word) <= 4 else 2


def regional_score(c: Column | str, tanglish: Column, hinglish: Column) -> Column:
    """Keyword score of the regional rules: 3+ hits 0.85, 2 hits 0.70."""
    lower, tamil = F.lower(text(c)), has_tamil(c)
    n = (
        F.when(tamil, hit_count(lower, lx.TAMIL_TRIGGERS))
        .when(tanglish, hit_count(lower, lx.TANGLISH_TRIGGERS))
        .when(hinglish, hit_count(lower, lx.HINGLISH_TRIGGERS))
        .otherwise(0)
    )
    return F.when(n >= 3, 0.85).when(n == 2, 0.70).otherwise(0.0)


# -- context guards --------------------------------------------------------

def context_guards(lower: Column) -> Column:
    """Informational contexts that lower the weight of a text-only score."""
    long_numbers = F.regexp_count(lower, F.lit(r"\b\d{4,}\b"))
    amount = lower.rlike(r"rs\.?\s*\d") | lower.rlike(r"inr\s*\d")
    numbers = F.regexp_count(lower, F.lit(r"\b\d+(?:\.\d+)?\b"))
    return F.struct(
        (hit_count(lower, lx.ACADEMIC_TERMS) >= 2).alias("academic"),
        ((hit_count(lower, lx.AGRICULTURE_TERMS) >= 2) | contains_any(lower, lx.SPREADSHEET_TERMS)
         | (numbers >= 8)).alias("structured"),
        ((hit_count(lower, lx.BANK_TERMS) >= 2) | (amount & (long_numbers >= 2))).alias("bank"),
        (hit_count(lower, lx.RETAILER_TERMS) >= 2).alias("retailer"),
    )


def reward_context(lower: Column) -> Column:
    return lower.contains("cashback") & contains_any(lower, ["wallet", "bill", "credited", "valid for"])


def suspicious_link(url: Column) -> Column:
    lower = F.lower(url)
    return (
        contains_any(lower, ["bit.ly", "tinyurl", ".xyz", ".top/"]) | lower.endswith(".top")
        | lower.rlike(IPV4_URL_PATTERN)
    )


def shortened_link(url: Column) -> Column:
    return contains_any(F.lower(url), lx.MOBILE_SHORTENERS)


def strong_scam_evidence(lower: Column, urls: Column) -> Column:
    bad_link = F.exists(urls, suspicious_link)
    return (
        contains_any(lower, lx.SCAM_REQUEST_TERMS) | contains_any(lower, lx.SCAM_LURE_TERMS)
        | (contains_any(lower, lx.SCAM_LINK_TERMS) & bad_link) | bad_link
    )


def collect_fraud(c: Column | str) -> Column:
    """A payment deep link that asks for money instead of paying it."""
    lower = F.lower(text(c))
    return lower.contains("upi://pay") & (lower.contains("mode=collect") | lower.rlike(r"\bcollect\b"))


def payment_link_score(c: Column | str) -> Column:
    lower = F.lower(text(c))
    return F.when(collect_fraud(c), 95).when(lower.contains("upi://pay"), 40).otherwise(0)


# -- OCR text --------------------------------------------------------------

def garbled(c: Column | str) -> Column:
    """At least three tokens of which 40 % look like misread script."""
    value = strip(text(c))
    tokens = words(value)

    def noisy(token: Column) -> Column:
        clean = F.regexp_replace(F.lower(token), r"[^\p{L}\p{Nd}]", "")
        mixed = clean.rlike(r"(?i)[a-z]\d[a-z]|\d[a-z]\d|[a-z]{1,2}\d{2,}[a-z]{1,2}")
        odd_script = token.rlike(r"[\x{0100}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF}]")
        no_vowel = (
            ~clean.isin(lx.COMMON_OCR_WORDS) & ~clean.rlike(r"^\p{Nd}+$")
            & (F.length(clean) >= 6) & ~clean.rlike("[aeiou]")
        )
        return (F.length(clean) >= 3) & (mixed | odd_script | no_vowel)

    n = F.size(tokens)
    return (
        (F.length(value) >= 8) & ~has_tamil(value) & (n >= 3)
        & (F.size(F.filter(tokens, noisy)) / F.greatest(n, F.lit(1)) >= 0.40)
    )


def repair_screen_domain(c: Column | str) -> Column:
    """Undo usual OCR misreads in a host or URL."""
    lower = F.lower(strip(text(c)))
    return (
        F.when(lower.isin("ijo.com", "www.ijo.com"), F.lit("jio.com"))
        .when(lower.endswith(".ijo.com"), F.replace(lower, F.lit(".ijo.com"), F.lit(".jio.com")))
        .when(lower.contains("hdfc") & lower.contains("rn"), F.replace(lower, F.lit("rn"), F.lit("m")))
        .when(lower.startswith("http") & lower.contains("0"), F.translate(lower, "01", "ol"))
        .otherwise(lower)
    )
