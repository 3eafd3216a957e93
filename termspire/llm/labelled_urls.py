"""A small labelled table of URLs, made from lists of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Words that unwanted hosts are named after.
UNWANTED = (
    "casino poker roulette jackpot slots lottery bets betting bookmaker gambling pills viagra cialis "
    "pharmacy-online cheap-meds steroids weight-loss adult porn xxx sex-cams escort nude hentai ads adserver "
    "track tracker click-pixel popunder banner-farm spam link-farm seo-links malware phishing botnet warez "
    "crackz keygen torrents free-money payday-loans quick-cash forex-profit crypto-doubler replica-watches "
    "fake-bags free-iphone win-prizes cheap free-bets winner hot-singles"
).split()
# Words that ordinary hosts are named after.
ORDINARY = (
    "news blog wiki docs library school university museum weather recipes garden sports travel music health "
    "science city forum photos maps books theatre history nature farmers kitchen bicycle mountain river ocean "
    "harbour station gallery journal review magazine daily times herald chronicle tribune academy institute "
    "hospital clinic parliament council village cottage bakery brewery orchard meadow forest island bridge "
    "castle cathedral market workshop studio theory algebra physics chemistry biology geology astronomy "
    "philosophy language grammar poetry novel painting sculpture dance opera cinema radio letters thread "
    "other another either ration nation station mention reading writing thinking things rather weather "
    "winter window wine farming trackside adapter advice cheese freedom sparrow clicker"
).split()
HOSTS = ["{}.example.com", "www.{}.example.org", "m.{}.example.net", "blog.{}.com", "{}.net", "the-{}.org"]
UNWANTED_HOSTS = ["{}.example.com", "www.{}.example.org", "m.{}.example.net", "best-{}.com", "{}-online.net", "{}24.org"]
PATHS = ["/", "/en/12", "/de/3456.html", "/fr/78?page=2", "/es/9/", "/en/1011#top", "/a/b/c.html", ""]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, block): every word on two hosts of its kind, with paths that say nothing.

    Ordinary hosts are also named after blends of two words, since most names are no known word.
    """
    rows = []
    blends = [
        first[: 2 + n % 3] + second[-(2 + n % 4) :]
        for k in (1, 7, 19)
        for n, (first, second) in enumerate(zip(ORDINARY, ORDINARY[k:] + ORDINARY[:k], strict=True))
    ]
    for words, hosts, block in ((UNWANTED, UNWANTED_HOSTS, 1), (ORDINARY + blends, HOSTS, 0)):
        for n, word in enumerate(words):
            for k in range(2):
                host = hosts[(n + 3 * k) % len(hosts)].format(word)
                scheme = "https" if (n + k) % 3 else "http"
                rows.append((f"{scheme}://{host}{PATHS[(n + 5 * k) % len(PATHS)]}", block))
    return spark.createDataFrame(rows, "url string, block int")
