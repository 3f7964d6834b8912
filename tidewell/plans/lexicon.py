"""Word lists of query understanding, and dictionaries derived from a corpus; surfaces are folded on use.

Lists under "fixed values" belong to the query language and are given whole; the others are a small lexicon of our own, which
``from_corpus`` replaces by what the corpus has.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, letter_words, ngrams

#: category -> surfaces
CATEGORIES: dict[str, list[str]] = {
    "Nhà hàng": ["nhà hàng", "quán ăn", "tiệm ăn", "restaurant"],
    "Quán cà phê": ["cà phê", "quán cà phê", "coffee", "cafe"],
    "Khách sạn": ["khách sạn", "hotel", "chỗ nghỉ"],
    "Bệnh viện": ["bệnh viện", "phòng khám", "hospital"],
    "Công viên": ["công viên", "park", "vườn hoa"],
    "Siêu thị": ["siêu thị", "supermarket", "trung tâm mua sắm"],
}
#: city -> surfaces, in the order in which they are tried (fixed values)
CITIES: dict[str, list[str]] = {
    "Hà Nội": ["hanoi", "hn"],
    "TP.HCM": ["tp hcm", "tp. hcm", "tphcm", "hcm", "sài gòn", "saigon", "hồ chí minh", "sg"],
    "Đà Nẵng": ["danang"],
    "Đà Lạt": ["dalat"],
}
#: (district, city)
DISTRICTS: list[tuple[str, str]] = [("Quận 1", "TP.HCM"), ("Quận 3", "TP.HCM"), ("Quận 7", "TP.HCM"), ("Hoàn Kiếm", "Hà Nội"), ("Hải Châu", "Đà Nẵng")]
#: landmark -> latitude, longitude, city
LANDMARKS: dict[str, tuple[float, float, str]] = {"chợ bến thành": (10.772, 106.698, "TP.HCM"), "hồ gươm": (21.0287, 105.8523, "Hà Nội"), "cầu rồng": (16.0611, 108.2272, "Đà Nẵng")}
ATTRIBUTES: list[str] = ["yên tĩnh", "sân vườn", "chỗ đậu xe", "view đẹp", "đông khách", "giá rẻ", "mở khuya", "máy lạnh", "ồn ào", "đắt đỏ"]
#: Abbreviations, in the order in which they are written out (fixed values).
ABBREVIATIONS: dict[str, str] = {
    "bv": "bệnh viện", "ks": "khách sạn", "nh": "nhà hàng", "cf": "cà phê", "cfe": "cà phê", "tttm": "trung tâm thương mại", "rp": "rạp phim", "cv": "công viên", "nt": "nhà thuốc",
    "hn": "Hà Nội", "sg": "Sài Gòn", "tphcm": "thành phố Hồ Chí Minh", "hcm": "Hồ Chí Minh", "dn": "Đà Nẵng", "đn": "Đà Nẵng", "dl": "Đà Lạt", "đl": "Đà Lạt",
}
#: Attribute -> its opposite (fixed values).
ANTONYMS: dict[str, str] = {"đông khách": "yên tĩnh", "ồn ào": "yên tĩnh", "náo nhiệt": "yên tĩnh", "đắt đỏ": "giá rẻ", "đắt": "giá rẻ"}
#: Cue words, folded (fixed values).
NEAR_CUES, NEAR_WINDOW = ("gan", "near", "canh", "sat", "quanh"), 15
POPULAR_CUES = ("noi tieng", "famous", "best", "ngon", "hot", "dang di", "dang den")
#: Words without content, folded (fixed values).
STOP_WORDS = frozenset(
    "can tim muon chi di hoi xin o tai gan sat canh xung quanh phia tren duoi ben co la va de nhung cac mot vai "
    "nhat noi ma thi cung duoc bi boi nao dau gi sao khong day kia nay do ay qua rat lam nhu voi near".split()
)
#: Words of limits, units and times, which the typo step leaves alone besides those above.
GRAMMAR = "quận phường đường gần ở tại có không giá dưới trên tầm khoảng sau trước hơn kém triệu star sao giờ mở đóng cửa nhất đánh giá tiền đang sáng chiều tối đêm".split()
#: A lexicon is held by value: more different names of a kind than this are an error.
MOST_NAMES = 100_000


@dataclass(frozen=True)
class Lexicon:
    """Everything query understanding looks up; small by contract and held by value."""

    categories: dict[str, list[str]] = field(default_factory=lambda: CATEGORIES)
    cities: dict[str, list[str]] = field(default_factory=lambda: CITIES)
    districts: list[tuple[str, str]] = field(default_factory=lambda: DISTRICTS)
    landmarks: dict[str, tuple[float, float, str]] = field(default_factory=lambda: LANDMARKS)
    attributes: list[str] = field(default_factory=lambda: ATTRIBUTES)
    abbreviations: dict[str, str] = field(default_factory=lambda: ABBREVIATIONS)
    antonyms: dict[str, str] = field(default_factory=lambda: ANTONYMS)
    centroids: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    extra_phrases: list[str] = field(default_factory=list)

    def phrases(self) -> list[str]:
        """Accented phrases in a fixed order, that accents and typos are mended towards."""
        out = [s for v in self.categories.values() for s in v] + list(self.categories) + list(self.cities) + [s for v in self.cities.values() for s in v] + [d for d, _ in self.districts] + list(self.landmarks) + self.attributes + list(self.abbreviations.values()) + self.extra_phrases
        return [p.lower() for p in dict.fromkeys(out)]

    def category_rules(self) -> list[tuple[str, str]]:
        """(folded surface, category): longest first, then by alphabet."""
        return sorted({(fold_text(s), c) for c, v in self.categories.items() for s in [c, *v]}, key=lambda x: (-len(x[0]), x))

    def district_rules(self) -> list[tuple[str, str, str]]:
        """(folded surface, district, city); numbered ones also as q1, q.1 and district 1."""
        out = set()
        for d, city in self.districts:
            f = fold_text(d)
            out.add((f, d, city))
            if f.startswith("quan ") and f[5:].isdigit():
                out |= {(s, d, city) for s in (f"q{f[5:]}", f"q.{f[5:]}", f"district {f[5:]}")}
        return sorted(out, key=lambda x: (-len(x[0]), x))


def from_corpus(places: DataFrame, base: Lexicon | None = None) -> Lexicon:
    """``base`` with the categories, cities, districts, centroids and attributes of a corpus; abbreviations that are words there are left out.

    Aliases stay where the corpus has their city or category; cities without any come last, by name.
    """
    base = base or Lexicon()

    def names(column) -> list[tuple]:
        rows = places.select(column).distinct().limit(MOST_NAMES + 1).collect()
        if len(rows) > MOST_NAMES:
            raise ValueError(f"over {MOST_NAMES} names of one kind don't make a lexicon")
        return sorted(r[0] for r in rows if r[0])

    cities, categories = names(F.col("city")), names(F.col("category"))
    centre = {(r["city"], r["district"]): (r["lat"], r["lon"]) for r in district_centroids(places).collect()}  # at most a row per district
    pairs = [tuple(x) for x in names(F.when((F.col("district") != "") & (F.col("city") != ""), F.struct("district", "city")))]
    return replace(
        base,
        categories={c: base.categories.get(c, []) for c in categories},
        cities={c: base.cities[c] for c in base.cities if c in cities} | {c: [] for c in cities if c not in base.cities},
        districts=pairs,
        centroids=centre,
        attributes=names(F.explode("attributes")),
        landmarks={n: v for n, v in base.landmarks.items() if v[2] in cities},
        abbreviations=unambiguous(places, base.abbreviations),
    )


def unambiguous(places: DataFrame, abbreviations: dict[str, str]) -> dict[str, str]:
    """The abbreviations that are no words of names, categories, districts, cities or attributes of the corpus."""
    text = F.concat_ws(" ", "name", "category", "district", "city", F.concat_ws(" ", "attributes"))
    seed = places.sparkSession.createDataFrame([(k, v, fold_text(k)) for k, v in abbreviations.items()], "abbreviation string, full string, short string")
    kept = guarded_abbreviations(seed, places.select(F.explode(letter_words(text)).alias("word")))
    left = {r["abbreviation"] for r in kept.collect()}
    return {k: v for k, v in abbreviations.items() if k in left}


def accent_votes(rows: DataFrame, text_col: str, order_col: str, max_gram: int = 1) -> DataFrame:
    """key (folded), value: the most frequent accented form of each word (or n-gram), the first seen among equals."""
    words = rows.select(F.col(order_col).alias("o"), letter_words(F.lower(F.col(text_col))).alias("w"))
    grams = words.select("o", F.posexplode(ngrams(F.col("w"), max_gram)).alias("i", "value"))
    # Occurrences are counted before anything is folded, so each different form is folded once.
    counted = grams.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct("o", "i")).alias("first"))
    votes = counted.withColumn("key", fold(F.col("value")))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "first")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "value", "n")


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def district_centroids(places: DataFrame) -> DataFrame:
    """Median position per city and district; unknown positions don't count. Tasks send on counts of different values, not rows."""
    return places.where((F.col("lat") != 0) | (F.col("lon") != 0)).groupBy("city", "district").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))


def guarded_abbreviations(seed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Abbreviations that are no words of the corpus; seed: short, full; vocabulary: word."""
    return seed.join(vocabulary.select(fold(F.col("word")).alias("short")).distinct(), "short", "left_anti")
