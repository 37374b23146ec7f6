from pyspark.sql import functions as F

from riskframe.functions import text as tx
from riskframe.operators.language import build_vocabulary, detect_romanised, encode_tokens


def test_redaction_order(one):
    raw = "mail john.doe@corp.com or call 415-555-0199, card 4111 1111 1111 1111, ssn 123-45-6789"
    out = one(tx.redact_pii("t"), t=raw)
    assert "j***@corp.com" in out and "[REDACTED_PHONE]" in out and "[REDACTED_SSN]" in out
    assert "4111 1111" not in out
    assert one(tx.redact_pii("t"), t="") == ""


def test_outbound_redaction(one):
    assert one(tx.redact_codes("t"), t="OTP 483920 pin: 99") == "OTP [REDACTED_OTP] pin: [REDACTED]"
    assert one(tx.redact_contact("t"), t="pay shop@upi or a@b.com") == "pay [REDACTED_UPI] or [REDACTED_EMAIL]"


def test_masks_and_keys(one):
    assert one(tx.mask_email("t"), t="sender@company.com") == "s***@company.com"
    assert one(tx.mask_email("t"), t="x@company.com") == "***@company.com"
    assert one(tx.mask_email("t"), t="plain") == "plain"
    assert one(tx.normalize_sender("t"), t=" +91 (415) 555-0199 ") == "4155550199"
    assert one(tx.normalize_sender("t"), t="Bob@X.com ") == "bob@x.com"
    assert one(tx.normalize_indicator(F.lit("url_domain"), "t"), t="https://Evil.example.com/a/") == "evil.example.com"
    assert one(tx.normalize_indicator(F.lit("sender_email"), "t"), t="Eve <EVE@bad.com>") == "eve@bad.com"


def test_url_extraction_keeps_first_sight_order(one):
    got = one(tx.extract_urls("t"), t="b http://b.com. a (http://a.com) again http://b.com")
    assert got == ["http://b.com", "http://a.com"]
    got = one(tx.extract_screen_urls("t"), t="at 14:02 see secure-bank-login.com, v1.2 file.pdf 185.34.22.10/login www.x.org e.g")
    assert got == ["secure-bank-login.com", "185.34.22.10/login", "www.x.org"]


def test_signal_groups(one):
    count = lambda t: one(tx.signal_count(tx.text_signals("t")), t=t)
    assert count("Urgent: click here and share your OTP") == 3
    assert count("Do not share your OTP with anyone") == 0
    assert count("lunch tomorrow?") == 0


def test_exposure_is_masked(one):
    found = one(tx.exposure_findings("t"), t="password: hunter2secret")
    assert [(f["type"], f["masked"]) for f in found] == [("plaintext password", "password: hu***")]
    assert one(tx.exposed_types("t"), t="OTP is 483920") == ["static OTP"]


def test_forwarding_levels(one):
    body = "see below\n---------- Forwarded message ----------\nFrom: Eve <eve@bad.com>\nDate: Mon\nSubject: hi\n\ntext"
    f = one(tx.forwarding("b", "s"), b=body, s="Hello")
    assert f["is_forwarded"] and f["evidence_level"] == "ORIGINAL HEADER EVIDENCE AVAILABLE"
    assert f["original_sender"] == "Eve <eve@bad.com>" and f["forwarder_commentary"] == "see below"
    f = one(tx.forwarding("b", "s"), b="note\nFrom: Mallory\nDate: Tue\nSubject: x", s="FWD: y")
    assert f["evidence_level"] == "PARTIAL ORIGINAL EVIDENCE" and f["forwarder_commentary"] == "note"
    assert one(tx.forwarding("b", "s"), b="plain", s="Fw: y")["evidence_level"] == "FORWARDER-ONLY EVIDENCE"
    assert not one(tx.forwarding("b", "s"), b="plain", s="y")["is_forwarded"]


def test_forwarding_reads_the_whole_text(one):
    body = "x" * 60_000 + "\nBegin forwarded message: \nFrom: late@a.com"
    assert one(tx.forwarding("b", "s"), b=body, s="")["original_sender"] == "late@a.com"


def test_adversarial_text(one):
    assert one(tx.normalize_adversarial("t"), t="0 t p v3rify paaaannungaaa") == "otp verify paannungaa"


def test_link_text_mismatch(one):
    html = '<a href="http://evil.net/x">https://bank.com</a><a href="https://ok.com/a">https://ok.com</a><a href="/x">text</a>'
    assert one(tx.link_mismatches("t"), t=html) == 1


def test_payment_links_and_guards(one):
    assert one(tx.payment_link_score("t"), t="upi://pay?pa=x&mode=collect") == 95
    assert one(tx.payment_link_score("t"), t="upi://pay?pa=x") == 40
    g = one(tx.context_guards(F.col("t")), t="rs.500 debited from a/c no 1234, available balance rs.900")
    assert g["bank"] and not g["academic"]


def test_garbled(one):
    assert one(tx.garbled("t"), t="rHlB6T Jio6T 6T680T6 15a02 x")
    assert not one(tx.garbled("t"), t="this is a normal message about your order")


def test_romanised_language_matches_brute_force(spark):
    from riskframe import lexicons as lx

    texts = [(1, "unga bank account block aagum udane verify pannunga"), (2, "meeting at noon"), (3, "turant khata band ho jayega")]
    out = {r["id"]: r for r in detect_romanised(spark.createDataFrame(texts, "id int, text string"), "id").collect()}
    assert out[1]["tanglish"] and out[3]["hinglish"] and not out[2]["tanglish"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    tokens = set("turant khata band ho jayega".split())
    expected = sum(any(distance(t, w) <= tx.fuzzy_distance(w) for w in lx.HINGLISH_WORDS) for t in tokens)
    assert out[3]["hinglish_words"] == expected


def test_vocabulary_and_encoding(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c zz")], "id int, text string")
    vocab = build_vocabulary(docs)
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids["a"] == 2 and set(ids) == {"a", "b", "c", "zz"}
    coded = {r["id"]: r["token_ids"] for r in encode_tokens(docs, vocab.filter("token <> 'zz'"), "id", width=5).collect()}
    assert coded[2][:3] == [2, ids["c"], 1] and coded[2][3:] == [0, 0]


def test_digests_of_mail_come_without_a_join(spark):
    from riskframe.plans.datasets import mail

    sf = "/root/testdata/sf0.001"
    rows = mail(spark, sf, "array(sha2(text, 256)) AS attachment_hashes")
    texts = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "sha2(text, 256) AS h").collect()}
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r["email_id"]: r["attachment_hashes"] for r in rows.select("email_id", "attachment_hashes").collect()} == {k: [h] for k, h in texts.items()}
