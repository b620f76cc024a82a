"""Personal data in decisions: places with their types, and text with typed placeholders.

Numbers are validated (check digits, labels, dialling forms) and replaced by pseudonyms from a keyed
Feistel permutation of their own format, so that equal values stay equal across documents and can't
be turned back without the key. Names, e-mail and postal addresses get a keyed tag instead.

First names are learnt from the collection: the words that open capitalised runs behind roles and
titles, then the contexts in which these stand, then all words that mostly stand in such contexts. The
list below is one more source. What is learnt reaches the tasks as a filter of fixed size.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
import secrets
from collections import Counter
from collections.abc import Callable, Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.llm.words import turkish_lower
from terazi.session import written

#: The setting that holds the key of the pseudonyms. Without it every run has a key of its own.
KEY_SETTING = "spark.terazi.personal.key"
_U, _L = "A-ZÇĞİÖŞÜÂÎÛ", "a-zçğıöşüâîû"
_CAP = f"[{_U}][{_U}{_L}]+"

#: Common first names (fixed values), a source besides the collection.
FIRST_NAMES = frozenset(
    """ahmet ali alper arda asuman ayhan aylin ayşe aysel banu barış başak belgin berk betül bülent burak burcu cem cemal cengiz
    ceren cihan çağlar çiğdem damla defne deniz derya didem dilek ebru ece ela elif emel emine emre engin ercan erdem eren erhan
    erkan erol esra fadime faruk fatih fatma ferhat feride figen fikret filiz funda gamze gizem gökhan gönül gül gülay gülşen gülten
    hakan halil hande hasan hatice havva hülya hüseyin ibrahim ilker ilknur inci ismail kaan kadir kamil kemal kenan kerem koray
    levent leyla mehmet melek meltem meryem mert mesut mine murat musa mustafa mutlu nalan nazan nazlı necati nermin nesrin nihal
    nilgün nurcan nuray nuri oğuz okan onur orhan osman ozan ömer özcan özge özgür özlem pelin pınar ramazan recep rıza sabri
    salih seda selçuk selim selin selma sema serap sercan serdar serkan sevda sevgi sevim sibel sinan songül suat süleyman şebnem
    şerife şükran şükrü taner tarık tolga tuncay turgut tülay tülin uğur umut ülkü ümit vedat veli volkan yasemin yasin yaşar yavuz
    yeliz yıldız yılmaz yunus yusuf zafer zehra zeki zeliha zeynep zuhal""".split()
)
#: Words that a person's name does not hold (fixed values).
NOT_NAMES = frozenset(
    """mahkemesi mahkeme dairesi daire kurulu kurul kanunu kanun bakanlığı başkanlığı belediye belediyesi müdürlüğü üniversitesi
    vakfı derneği birliği kooperatifi şirketi sanayi ticaret limited anonim ltd aş bankası hastanesi okulu lisesi mahallesi mah mh
    sokak sokağı sok sk caddesi cad cd bulvarı blv köyü başkan üye tanık davacı davalı vekili av dr prof doç müteveffa adres tel
    hukuk ceza genel idari vergi dava bölge adliye asliye türk borçlar yargıtay danıştay""".split()
)
#: Roles and titles behind which a person is named, lower-cased (fixed values).
ROLES = frozenset(
    """davacı davalı asil tanık müteveffa mirasçısı muris muhtar kâtip katip mühendis bilirkişi hâkim hakim başkan üye müvekkil
    müvekkili sanık müşteki şüpheli mağdur katılan avukat av dr prof doç""".split()
)

_NAME = re.compile(rf"(?<![\w\[]){_CAP}(?:[ \xa0]{_CAP}(?:-{_CAP})?)+")
_WORD = re.compile(r"[^ \xa0]+")
_BEFORE = re.compile(r"([^\s<>;]+)[ \xa0]$")
_AFTER = re.compile(r"[ \xa0,(]+([^\s\d,;()<>]+)")
_IDENTIFIED = re.compile(r"[ \xa0,(]+(?:T\.C\.|TCKN|[Kk]imlik)")
_MAIL = re.compile(
    r"[\w.+%-]+(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[\w-]+(?:(?:\.|\s?[\[(]\s?(?:nokta|dot)\s?[\])]\s?)[\w-]+)+", re.I
)
_PLACEHOLDER = re.compile(r"\[[A-ZÇĞİÖŞÜ]{2,}[ _][^\[\]]{1,80}\]")
_IBAN = re.compile(r"TR\d{2}(?:[ ]?\d{4}){5}[ ]?\d{2}")
_PHONE = re.compile(
    r"(?<![\w+/.,(-])(?:\+90[ .-]?\(?|90[ .-]\(?|0[ .-]?\(?|\(0)[2-5]\d{2}\)?[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}(?!\w|[/.,-]\d)"
    r"|(?<=\()(?:\+90[ .-]?|90[ .-]|0[ .-]?)[2-5]\d{2}[ .-]?\d{3}[ .-]?\d{2}[ .-]?\d{2}(?!\w|[/.,-]\d)"
)
_ID = re.compile(r"(?<![\w+/.,-])[1-9]\d{2} ?\d{3} ?\d{3} ?\d{2}(?!\w|[/.,-]\d)")
_FILE_BEFORE = re.compile(r"(?:takip|hesap|dosya|fatura|seri|esas|karar|poliçe|abone)\s*(?:no|numarası|seri)?\s*[:.]?\s*$", re.I)
_FILE_AFTER = re.compile(r"\s*(?:takip|dosya|hesap|fatura|abone)\s+(?:no|numara)", re.I)
_TAX = re.compile(r"(?:vergi\s+(?:kimlik\s+)?(?:no|num(?:arası)?)|VKN)\s*[:.]?\s*(\d{10})(?!\d)", re.I)
_PLACE = rf"[{_U}][{_U}{_L}'’-]+"
_QUARTER = rf"{_PLACE}\s(?:[Mm]ah(?:allesi|\.)?|MAH(?:ALLES[İI]|\.)?|[Mm]h\.?|MH\.?|[Kk]öyü|KÖYÜ),?\s"
_STREET = rf"(?:{_PLACE}|\d+\.)\s(?:[Ss]ok(?:ak|ağı|\.)?|SOK(?:AK|AĞI|\.)?|[Ss]k\.?|SK\.?|[Cc]ad(?:desi|\.)?|CAD(?:DES[İI]|\.)?|[Cc]d\.?|CD\.?|[Bb]ulvarı?|BULVARI?|[Bb]lv\.?|BLV\.?),?\s"
_DOOR = r"(?:[Nn]o|NO|[Nn]umara|NUMARA)\s?[.:]?\s?(\d+)"
_ADDRESS = re.compile(rf"(?<!\w)(?:{_QUARTER}(?:{_STREET})*|(?:{_STREET})+){_DOOR}")
_ADDRESS_END = re.compile(
    rf"(?:/\d+)?(?:\s(?:[Kk]at|KAT)\s?\d+)?(?:\s(?:[Dd]aire|DA[İI]RE|D)\s?:?\s?\d+)?,?(?:\s\d{{5}})?(?:\s{_PLACE}(?:\s?/\s?{_PLACE})?)?"
)


def valid_id(digits: str) -> bool:
    """Check digits of the 11-digit national id."""
    d = [int(c) for c in digits]
    return len(d) == 11 and d[0] != 0 and (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


class _Taken:
    """Disjoint stretches of a text in order; both questions take logarithmic time."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a)
        return not (i and self.ends[i - 1] > a) and not (i < len(self.starts) and self.starts[i] < b)

    def add(self, a: int, b: int) -> None:
        i = bisect.bisect_right(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def _role(word: str) -> bool:
    return turkish_lower(word).rstrip(".:") in ROLES


def _runs(text: str) -> Iterator[tuple[re.Match, list[tuple[int, str]], str]]:
    """Runs of capitalised words, each with its words and the word before it."""
    for run in _NAME.finditer(text):
        before = _BEFORE.search(text, max(0, run.start() - 24), run.start())
        yield run, [(m.start() + run.start(), m.group()) for m in _WORD.finditer(run.group())], before.group(1) if before else ""


def _names(text: str, taken: _Taken, known: Container[str]) -> Iterator[tuple[int, int]]:
    for run, words, before in _runs(text):
        identified = _IDENTIFIED.match(text, run.end())
        i = 0
        while i < len(words) - 1:
            at, word = words[i]
            low = turkish_lower(word)
            told = _role(words[i - 1][1] if i else before) or (identified and i >= len(words) - 3)
            if low in ROLES or not (told or low in known):
                i += 1
                continue
            last = i + 1
            if turkish_lower(words[last][1]) in known and last + 1 < len(words) and turkish_lower(words[last + 1][1]) not in NOT_NAMES:
                last += 1
            parts = {p for _, w in words[i : last + 1] for p in turkish_lower(w).split("-")}
            after = turkish_lower(words[last + 1][1]) if last + 1 < len(words) else ""
            if parts & NOT_NAMES or after in NOT_NAMES or turkish_lower(words[i + 1][1]) in ROLES:
                i += 1
                continue
            end = words[last][0] + len(words[last][1])
            if taken.free(at, end):
                yield at, end
            i = last + 1


_BIRTH = re.compile(r"(?:[Dd]oğum\s+tarihi|[Dd]\.\s?[Tt]\.)\s*:?\s*(\d{1,2})([./])(\d{1,2})\2(\d{4})(?!\d)|(?<!\d)(\d{1,2})([./])(\d{1,2})\6(\d{4})\s+doğumlu", re.I)


def find_personal(text: str, known: Container[str] = FIRST_NAMES, births: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, type) of each place, in order and without overlaps; positions from 0.

    ``known`` are first names in lower case; ``births`` adds labelled dates of birth (DOGUM)."""
    found: list[tuple[int, int, str]] = []
    taken = _Taken()
    for pattern in [_IBAN] * ("TR" in text) + [_PLACEHOLDER] * ("[" in text):
        for m in pattern.finditer(text):
            if taken.free(*m.span()):
                taken.add(*m.span())
    free = taken.free

    def add(a: int, b: int, kind: str) -> None:
        if free(a, b):
            found.append((a, b, kind))
            taken.add(a, b)

    if "@" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        for m in _MAIL.finditer(text):
            add(*m.span(), "EPOSTA")
    for m in _TAX.finditer(text):
        add(*m.span(1), "KIMLIK")
    for m in _PHONE.finditer(text):
        add(*m.span(), "TEL")
    for m in _ID.finditer(text):
        a, b = m.span()
        if valid_id(m.group().replace(" ", "")) and not _FILE_BEFORE.search(text[max(0, a - 24) : a]) and not _FILE_AFTER.match(text, b):
            add(a, b, "KIMLIK")
    for m in _ADDRESS.finditer(text):
        if free(*m.span()):
            end = _ADDRESS_END.match(text, m.end())
            add(m.start(), end.end() if end and free(m.start(), end.end()) else m.end(), "ADRES")
    for m in _BIRTH.finditer(text) if births else ():
        add(m.start(1 if m.group(1) else 5), m.end(4 if m.group(1) else 8), "DOGUM")
    for a, b in _names(text, taken, known):
        add(a, b, "KISI")
    return sorted(found)


# Format-preserving pseudonyms -------------------------------------------------------------------


def feistel(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 8) -> int:
    """A keyed permutation of 0..size-1: a Feistel network over two halves, walked until it fits."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(rounds):
            mac = hmac.new(key, b"%s|%d|%d" % (tweak, i, right), hashlib.sha256).digest()
            left, right = right, left ^ (int.from_bytes(mac[:8], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def feistel_back(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 8) -> int:
    """The inverse of ``feistel``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in reversed(range(rounds)):
            mac = hmac.new(key, b"%s|%d|%d" % (tweak, i, left), hashlib.sha256).digest()
            left, right = right ^ (int.from_bytes(mac[:8], "big") & mask), left
        value = left << half | right
        if value < size:
            return value


def pseudonym_id(digits: str, key: bytes, walk: Callable = feistel) -> str:
    """Another national id with right check digits."""
    core = walk(int(digits[:9]) - 10**8, 9 * 10**8, key, b"id") + 10**8
    d = [int(c) for c in str(core)]
    d.append((7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10)
    d.append(sum(d) % 10)
    return "".join(map(str, d))


def tax_check_digit(nine: str) -> int:
    """The tenth digit of a tax number."""
    total = 0
    for i, c in enumerate(nine):
        shifted = (int(c) + 9 - i) % 10
        total += shifted and (shifted * 2 ** (9 - i) % 9 or 9)
    return -total % 10


def pseudonym_tax(digits: str, key: bytes, walk: Callable = feistel) -> str:
    """Another tax number; its check digit is right if the given one's is, and wrong by as much if not."""
    off = (int(digits[9]) - tax_check_digit(digits[:9])) % 10
    nine = f"{walk(int(digits[:9]), 10**9, key, b'tax'):09d}"
    return nine + str((tax_check_digit(nine) + off) % 10)


def pseudonym_phone(digits: str, key: bytes, walk: Callable = feistel) -> str:
    """The subscriber number is permuted; country and area stay."""
    return digits[:-7] + f"{walk(int(digits[-7:]), 10**7, key, b'tel' + digits[-10:-7].encode()):07d}"


_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1), 73_049  # to 31.12.2099


def pseudonym_date(day: datetime.date, key: bytes, walk: Callable = feistel) -> datetime.date:
    """Another day of 1900 to 2099; days outside stay as they are."""
    n = (day - _FIRST_DAY).days
    if not 0 <= n < _DAYS:
        return day
    return _FIRST_DAY + datetime.timedelta(days=walk(n, _DAYS, key, b"date"))


def _digits_into(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _plain_mail(value: str) -> str:
    """An address however it is spelled: ``ali [at] x [nokta] com`` is ``ali@x.com``."""
    mail = re.sub(r"\s?[\[(]\s?at\s?[\])]\s?", "@", turkish_lower(value).replace("ı", "i"))
    return re.sub(r"\s+", "", re.sub(r"\s?[\[(]\s?(?:nokta|dot)\s?[\])]\s?", ".", mail))


def placeholder(value: str, kind: str, key: bytes) -> str:
    """``[KIMLIK 123 456 789 01]`` for numbers and dates, ``[KISI 3f9c2a1b]`` for the rest. Equal values
    get equal placeholders however they are spaced, cased or written out; a date that doesn't exist
    gets a tag."""
    if kind in ("KIMLIK", "TEL"):
        digits = "".join(c for c in value if c.isdigit())
        change = pseudonym_phone if kind == "TEL" else pseudonym_id if len(digits) == 11 else pseudonym_tax
        return f"[{kind} {_digits_into(value, change(digits, key))}]"
    if kind == "DOGUM":
        day, month, year = (int(x) for x in re.split(r"[./]", value))
        try:
            other = pseudonym_date(datetime.date(year, month, day), key)
            return f"[{kind} {other:%d}{'/' if '/' in value else '.'}{other:%m}{'/' if '/' in value else '.'}{other.year:04d}]"
        except ValueError:
            pass
    same = _plain_mail(value) if kind == "EPOSTA" else " ".join(turkish_lower(value).split())
    return f"[{kind} {hmac.new(key, f'{kind}|{same}'.encode(), hashlib.sha256).hexdigest()[:8]}]"


def mask(text: str, key: bytes, known: Container[str] = FIRST_NAMES) -> str:
    """The text with a typed placeholder for each place, all else unchanged."""
    out, at = [], 0
    for a, b, kind in find_personal(text, known, births=True):
        out += [text[at:a], placeholder(text[a:b], kind, key)]
        at = b
    return "".join([*out, text[at:]])


# Names learnt from the collection ---------------------------------------------------------------

#: How often a word has to stand in contexts of names, and which part of its capitalised runs.
LEAST, PART = 3, 0.3
#: How often a context has to occur, and which part of it has to be names.
CONTEXT_LEAST, CONTEXT_PART = 50, 0.9
#: Cells of the filter that carries the names to the tasks: at most so many bits, whatever the collection.
CELLS = 1 << 21


class Names:
    """First names: the list, and a Bloom filter of what was learnt."""

    def __init__(self, cells: np.ndarray, listed: frozenset[str] = FIRST_NAMES):
        bits = np.zeros(CELLS, bool)
        bits[cells] = True
        self.bits, self.listed, self.seen = np.packbits(bits), listed, {}

    def __contains__(self, word: str) -> bool:
        found = self.seen.get(word)
        if found is None:
            h = xxhash.xxh64_intdigest(word, 42)  # what Spark's xxhash64 gives
            found = word in self.listed or all(self.bits[c >> 3] >> (7 - (c & 7)) & 1 for c in ((h >> k) & (CELLS - 1) for k in (0, 21, 42)))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = found
        return found


def name_candidates(texts: DataFrame) -> DataFrame:
    """``w, l, r, bad, n``: words that open a capitalised run, or follow a role in one, with the words
    around; ``bad`` where the run holds what no person's name does."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(held)
            out = pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in rows], pa.string()) for i in range(3)), pa.array([x[3] for x in rows], pa.bool_()), pa.array(list(held.values()), pa.int64())], ["w", "l", "r", "bad", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for run, words, before in _runs(text):
                    low = [turkish_lower(w) for _, w in words]
                    after = _AFTER.match(text, run.end())
                    for i in range(len(low) - 1):
                        if low[i] in ROLES or low[i] in NOT_NAMES or (i and low[i - 1] not in ROLES):
                            continue
                        rest = low[i + 1 :]
                        held[low[i], low[i - 1] if i else turkish_lower(before).rstrip(".:"), turkish_lower(after.group(1)) if after else "", len(rest) > 3 or not NOT_NAMES.isdisjoint(rest)] += 1
            if len(held) > 100_000:
                yield flush()
        yield flush()

    return texts.select("text").filter("text is not null").mapInArrow(scan, "w string, l string, r string, bad boolean, n long").groupBy("w", "l", "r", "bad").agg(F.sum("n").alias("n"))


def learnt_names(candidates: DataFrame, listed: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """``w``: first names by the contexts they stand in. Roles and the list give the first names, these
    give contexts, and the contexts give all names. Everything is counted by joins and sums."""
    role = F.col("l").isin(*sorted(ROLES))
    sound = F.when(F.col("bad"), 0).otherwise(F.col("n"))

    def names(rows: DataFrame, told: Column) -> DataFrame:
        sums = rows.groupBy("w").agg(F.sum(F.when(told, sound).otherwise(0)).alias("p"), F.sum("n").alias("a"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"))
        return sums.filter((F.col("p") >= LEAST) & (F.col("p") >= PART * F.col("a")) & (F.col("b") * 10 <= F.col("a"))).select("w")

    first = names(candidates, role)
    known = candidates.join(first.withColumn("_k", F.lit(True)), "w", "left").withColumn("_k", F.coalesce("_k", F.lit(False)) | F.col("w").isin(*sorted(listed)))

    def contexts(side: str) -> DataFrame:
        sums = known.filter(F.col(side) != "").groupBy(side).agg(F.sum(F.when(F.col("_k"), sound).otherwise(0)).alias("p"), F.sum("n").alias("a"))
        return sums.filter((F.col("a") >= CONTEXT_LEAST) & (F.col("p") >= CONTEXT_PART * F.col("a"))).select(side)

    rows = candidates.join(contexts("l").withColumn("_l", F.lit(True)), "l", "left").join(contexts("r").withColumn("_r", F.lit(True)), "r", "left")
    return names(rows, F.coalesce("_l", F.lit(False)) | F.coalesce("_r", F.lit(False)) | role).unionByName(first).distinct()


def known_names(texts: DataFrame, listed: frozenset[str] = FIRST_NAMES) -> Names:
    """The names learnt from all ``texts`` (``text``). At most ``CELLS`` numbers come to the driver."""
    h = F.xxhash64("w")
    cells = F.explode(F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(CELLS - 1)).cast("int") for k in (0, 21, 42)])).alias("c")
    learnt = learnt_names(written(name_candidates(texts)), listed).select(cells).distinct()
    return Names(learnt.toArrow()["c"].to_numpy(), listed)


# Spark ------------------------------------------------------------------------------------------


def personal_places(texts: DataFrame, known: Container[str] = FIRST_NAMES) -> DataFrame:
    """``kaynak, belge_id, tur, bas`` of ``texts`` (``kaynak, belge_id, text``), each place once.

    Null and empty texts hold none; rows that repeat a document count once; a document with two
    different texts has the places of both; other columns are ignored."""
    names = texts.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for source, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for a, _, kind in find_personal(text, names.value):
                    for k, v in enumerate((source, key, kind, a + 1)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.string()) for v in out[:3]), pa.array(out[3], pa.int32())], ["kaynak", "belge_id", "tur", "bas"])

    rows = texts.select("kaynak", F.col("belge_id").cast("string"), F.col("text").cast("string")).filter("text is not null")
    return rows.mapInArrow(scan, "kaynak string, belge_id string, tur string, bas int").distinct()


def session_key(spark: SparkSession) -> bytes:
    """The key of ``KEY_SETTING``; a random one for this call where it is unset, so that nobody can turn
    its pseudonyms back and values are linked within the result only."""
    known = spark.conf.get(KEY_SETTING, None)
    return known.encode() if known else secrets.token_bytes(32)


def masked_texts(texts: DataFrame, key: bytes | None = None, known: Container[str] = FIRST_NAMES) -> DataFrame:
    """``kaynak, belge_id, maskeli``; null texts stay null."""
    key = session_key(texts.sparkSession) if key is None else key
    names = texts.sparkSession.sparkContext.broadcast(known)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if t is None else mask(t, key, names.value) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], ["kaynak", "belge_id", "maskeli"])

    rows = texts.select("kaynak", F.col("belge_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(replace, "kaynak string, belge_id string, maskeli string")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kaynak, belge_id, text``: one row for each decision and text of both tables."""

    def once(table: str, key: str, text: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select("kayit_no", F.col(key).alias("belge_id"), F.col(text).alias("text")).filter("text is not null")
        chosen = rows.groupBy("belge_id", F.xxhash64("text")).agg(F.min("kayit_no").alias("kayit_no")).select("kayit_no")
        return rows.join(chosen, "kayit_no", "left_semi").select(F.lit(table).alias("kaynak"), "belge_id", "text")

    return once("karar", "karar_id", "tam_metin").unionByName(once("danistay_karari", "id", "metin"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of personal data in the decisions of both courts."""
    texts = written(decisions(spark, sf_dir))
    return personal_places(texts, known_names(texts))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions with typed placeholders."""
    texts = written(decisions(spark, sf_dir))
    return masked_texts(texts, known=known_names(texts))
