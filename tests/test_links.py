"""Keyword links against plain Python on a few pages."""

from urllib.parse import urljoin, urlsplit

from horarium import registry
from horarium.functions.scalars import KEYWORDS
from horarium.sources.seeds import BLOCKED_HOSTS

LINKS = [("/prayer", "Prayer timetable salah times"), ("/a", "News"), ("/b", "Salat"), ("/NAMAZ", ""), ("/b", "salat again"), ("https://other.example/prayer", "Prayer"),
         ("/prayer-timetable-salah", "prayer timetable salah salat namaz jamaah iqamah")]


def test_keyword_links(spark, tmp_path):
    page = "".join(f'<a href="{h}">{t}</a>' for h, t in LINKS)
    pages = [(1, "https://mosque.example/x", page), (2, "https://www.facebook.com/m", page), (3, "https://notfacebook.com/", page)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for key, url, _ in pages:
        for n, (href, text) in enumerate(LINKS):
            target = urljoin(url, href)
            host = urlsplit(target).netloc
            listed = any(host == b or host.endswith("." + b) for b in BLOCKED_HOSTS)
            if host == urlsplit(url).netloc and not listed and any(k in f"{href} {text}".lower() for k in KEYWORDS):
                want.setdefault((key, target), n)
    got = registry.QUERIES["keyword_links"](spark, str(tmp_path)).collect()
    assert {(r.page_id, r.target): r.ordinal for r in got} == want and len(got) == len(want)
    assert (1, "https://mosque.example/prayer") in want and not any(k == 2 for k, _ in want)
