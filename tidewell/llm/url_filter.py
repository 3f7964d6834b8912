"""URL filter, in DataFrame functions only: rules first, then logistic regression on hashed character n-grams.

A rule is ``host/path-prefix`` with a verdict; it fits its host and all subdomains if the url's path starts with
the rule's; the longest fitting one wins, of equally long ones the alphabetically first.  Other urls are judged by a
logistic regression whose features are the n-grams of host and path, hashed by CRC-32 into ``BUCKETS``, counted
and scaled to unit length.  It is trained from a small labelled table of urls, in the dual form (one coefficient
per labelled url, a kernel matrix of inner products), so that the whole descent is one expression over one row.

Null urls and those without ``://`` have an empty host and path; they have no n-grams and get the bias alone.  Urls of
any length are taken whole, in time n log n.  A verdict depends on the url alone, so repeated rows and ids get equal ones.
Every input row gives one output row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .winnowing import let

BUCKETS, GRAM = 1024, 4
STEPS, RATE, RIDGE = 200, 0.5, 0.002
RULES: tuple[tuple[str, str], ...] = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Names and paths that such addresses have in general, written by hand: to block, and to allow.
BLOCKED = """
    poker-room/play poker-online/bonus online-poker/tables play-roulette/live roulette-online/bonus online-slots/play slots-jackpot/spin jackpot-slots/bonus betting-online/odds online-betting/live
    sports-betting/odds betting-tips/picks buy-viagra/order viagra-online/buy online-pharmacy/order pharmacy-discount/shop discount-viagra/buy discount-pharmacy/order diet-tablets/buy tablets-online/shop
    xxx-videos/watch porn-videos/watch erotic-videos/watch erotic-chat/cams live-erotic/cams sex-chat/join erotic-dating/join hot-singles/join nude-videos/gallery porn-gallery/pics
    payday-loans/apply quick-loans/apply loans-online/apply payday-credit/instant instant-loans/apply earn-money/start money-online/start crypto-money/invest money-doubler/invest
    replica-watches/buy replica-bags/buy watches-replica/sale luxury-replica/outlet fake-watches/sale adserver-banner/click banner-click/redirect adclick-banner/popup popup-banner/click adserver-popup/pixel pixel-adserver/click
    warez-download/crack crack-download/keygen keygen-download/serial torrent-download/movies movies-torrent/full serial-keygen/crack malware-download/setup download-setup/exe
    verify-account/login account-login/verify secure-login/update account-update/signin login-verify/account prize-claim/winner lottery-winner/claim winner-prize/survey lottery-prize/claim
    buy-backlinks/seo backlinks-seo/order link-exchange/seo seo-backlinks/buy
""".split()
ALLOWED = """
    library/catalogue museum/exhibitions university/lectures school/timetable archive/letters news/world gazette/politics weekly/essays radio/programmes chronicle/opinion
    recipes/soups garden/roses travel/rivers hiking/trails birds/species docs/manual wiki/history forum/threads journal/notes code/projects
    weather/north maps/towns trains/stations council/minutes parliament/debates hospital/visitors clinic/opening health/guides results/rowing chess/games
    music/scores film/reviews poetry/authors theatre/season gallery/painters science/journals maths/lemmas astronomy/comets geology/alps chemistry/elements
    mountains/peaks lakes/maps meadow/flowers orchard/apples forestry/oaks lighthouse/coast observatory/stars aquarium/fishes zoo/otters harvest/wheat
    vineyard/tour beekeeping/hives architecture/bridges engineering/turbines carpentry/joints pottery/glazes painting/lessons printing/type history/romans languages/latin
    dictionary/entries encyclopedia/articles philosophy/kant law/statutes economics/papers statistics/tables geography/islands biology/cells medicine/handbook nursing/courses
    orchestra/concerts choir/rehearsals dance/steps football/fixtures tennis/rules swimming/lanes kitchen/menus coffee/beans cheese/regions restaurant/reservations
    hotel/rooms camping/sites family/trees cycling/routes knitting/patterns bakery/breads harbour/tides railway/engines village/events monastery/gardens
    teachers/lessons students/reading children/stories parents/advice doctors/questions writers/letters readers/reviews painters/sketches sailors/charts walkers/paths
    castle/towers island/ferries valley/farms city/squares bridge/repairs market/vegetables cathedral/organ court/judgments bank/history post/stamps
""".split()
#: The same suffixes for both, all reserved for examples, so that no suffix tells anything.
SUFFIXES = ("example.com", "example.net", "example.org", "test")
LABELLED: tuple[tuple[str, int], ...] = tuple((f"https://{name.partition('/')[0]}.{suffix}/{name.partition('/')[2]}", label) for names, label in ((BLOCKED, 1), (ALLOWED, 0)) for k, name in enumerate(names) for suffix in [SUFFIXES[k % 4]])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(shared.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(text: Column, mark: str, n: int = GRAM) -> Column:
    """Buckets of the n-grams of ``mark`` + text + end; none for an empty text."""
    chars = F.split(F.concat(F.lit(mark), text, F.lit("$")), "")
    found = let(chars, lambda c: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.pmod(F.crc32(F.array_join(F.slice(c, i, n), "")), F.lit(BUCKETS)).cast("int"))).otherwise(F.array(F.pmod(F.crc32(F.array_join(c, "")), F.lit(BUCKETS)).cast("int"))))
    return F.when(F.length(text) > 0, found).otherwise(F.array().cast("array<int>"))


def features(host: Column, path: Column) -> Column:
    """All buckets of a url, repeated as often as they occur."""
    return F.concat(grams(host, "^"), grams(path, "~"))


def train(spark: SparkSession, labelled=LABELLED, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[list[float], float]:
    """Weights of the buckets and the bias. The labelled table is small by contract: it is squared."""
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "id int, url string, y double")
    rows = rows.select("id", "y", F.explode(features(host_of(F.col("url")), path_of(F.col("url")))).alias("b")).groupBy("id", "y", "b").agg(F.count("*").cast("double").alias("v"))
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    x = rows.join(norm, "id").select("id", "y", "b", (F.col("v") / F.col("norm")).alias("v"))
    kernel = x.alias("p").join(x.alias("q"), F.col("p.b") == F.col("q.b")).groupBy(F.col("p.id").alias("i"), F.col("q.id").alias("j")).agg(F.sum(F.col("p.v") * F.col("q.v")).alias("k"))
    rows_of = kernel.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("m"))
    ids = x.groupBy("id", "y").agg(F.lit(0).alias("_")).select("id", "y")
    n = len(labelled)
    line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    data = rows_of.join(ids, rows_of.i == ids.id).agg(F.array_sort(F.collect_list(F.struct("i", "y", line.alias("k")))).alias("rows"))

    def step(a: Column, _: Column) -> Column:  # a: a coefficient per labelled url, then the bias
        def error(r: Column) -> Column:
            z = F.aggregate(F.zip_with(r["k"], F.slice(a, 1, n), lambda k, c: k * c), F.lit(0.0), lambda s, v: s + v) + F.element_at(a, n + 1)
            return r["y"] - F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

        return let(F.transform("rows", error), lambda e: F.concat(F.zip_with(F.slice(a, 1, n), e, lambda c, g: c * F.lit(1.0 - rate * ridge) + F.lit(rate) * g), F.array(F.element_at(a, n + 1) + F.lit(rate / n) * F.aggregate(e, F.lit(0.0), lambda s, v: s + v))))

    solved = data.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array_repeat(F.lit(0.0), n + 1), step).alias("a"))
    solved = solved.select(F.posexplode("a").alias("id", "a"))
    weights = x.join(F.broadcast(solved), "id").groupBy("b").agg(F.sum(F.col("a") * F.col("v")).alias("w")).unionByName(solved.where(F.col("id") == n).select(F.lit(-1).alias("b"), F.col("a").alias("w")))
    found = {r["b"]: r["w"] for r in weights.collect()}  # at most BUCKETS + 1 rows
    return [found.get(b, 0.0) for b in range(BUCKETS)], found[-1]


def score(host: Column, path: Column, model: tuple[list[float], float]) -> Column:
    """Probability that the url is one to block."""
    table, bias = F.array(*[F.lit(w) for w in model[0]]), model[1]

    # Length of the vector of counts: equal buckets stand together once sorted; the k-th of them adds 2k - 1 to the square.
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def count(acc: Column, b: Column) -> Column:
        run = F.when(acc["last"] == b, acc["run"] + 1.0).otherwise(1.0)
        return F.struct(b.alias("last"), run.alias("run"), (acc["sum"] + 2.0 * run - 1.0).alias("sum"))

    def total(found: Column) -> Column:
        squares = F.aggregate(F.array_sort(found), start, count, lambda acc: acc["sum"])
        sums = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
        return F.lit(bias) + F.when(F.size(found) > 0, sums / F.sqrt(squares)).otherwise(0.0)

    return F.lit(1.0) / (F.lit(1.0) + F.exp(-let(features(host, path), total)))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The fitting rule that wins, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row."""
    model = train(pages.sparkSession, labelled)
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), score(F.col("host"), F.col("path"), model).alias("score"))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
