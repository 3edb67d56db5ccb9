"""Text functions on values stated by hand."""

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import predicates as P


def _one(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_entities(spark):
    assert _one(spark, X.clean_text, ["<![CDATA[a <b>c</b>]]> &#233;&#x1F600;&#39;x &amp;lt;i&amp;gt;", None, "", "&#0;"]) == ["a c é😀'x", None, "", "\ufffd"]
    assert _one(spark, X.strip_html, ["<p>a&nbsp;&lt;b&gt; &#8211; c</p><script>x()</script>d<br>e", None]) == ["a <b> – c\nd\ne", None]


def test_redacted(spark):
    said = ["https://x.org/?a=1&Token=ab.c&b=2", "Authorization: bearer  abc.DEF==", "https://api.example.org/bot12:xY_z/send", None, "no secret=here"]
    want = ["https://x.org/?a=1&Token=[REDACTED]&b=2", "Authorization: bearer [REDACTED]", "https://api.example.org/bot[REDACTED]/send", "", "no secret=here"]
    assert [x.replace("  ", " ") for x in _one(spark, X.redacted, said)] == want


def test_hosts(spark):
    said = ["http://user@127.0.0.1/", "http://[::1]/", "http://a.localhost/", "https://ok.org:80@evil.com/x", "HTTP://Example.org", "http://[fe80::1]/", "ftp://example.org", None]
    assert _one(spark, P.safe_url, said) == [False, False, False, True, True, False, False, None]
    assert _one(spark, lambda c: P.host_in(c, ["x.gov.in"]), ["https://x.gov.in:80@evil.com", "https://a.x.gov.in/", "http://x.gov.in/"]) == [False, True, False]
