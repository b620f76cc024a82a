"""Text that was read with a wrong character encoding.

Character trigram models, smoothed by bigrams and single characters, are counted over all clean rows
of a column but for a held-out part. Every piece of text with an unusual character is put through each
chain of re-encoding and decoding; the likeliest candidate wins if it beats the text, as it stands or in
its usual written form, by a margin. The margin is set on the held-out rows: on their words as they are
and as each chain damages them. Letters that were lost for good are recognised by how much likelier the
text is with a letter in their place, and are left marked.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terazi.llm.words import LOOK_ALIKES

#: The model's alphabet: Turkish, then the letters and signs that sound foreign words and technical
#: articles add (fixed values). All other characters share one class, so a model has at most
#: (len(ALPHABET) + 1) ** 3 cells.
TURKISH = " \n.,;:()/-'\"%0123456789abcçdefgğhıijklmnoöpqrsştuüvwxyzâîûABCÇDEFGĞHIİJKLMNOÖPQRSŞTUÜVWXYZÂÎÛ!"
FOREIGN = "ÀÁÃÄÅÆÈÉÊËÍÑÓÔÕØÚßàáãäåæèéêëíïñóôõøùúČčŁłŃńŚśŠšŹźŻżŽžÞþÝýÐð“”‘’«»–…°²³½№?"
ALPHABET = TURKISH + FOREIGN
_SIZE = len(ALPHABET) + 1
_INDEX = np.full(0x110000, _SIZE - 1, np.int16)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

#: Encodings that Turkish pages are wrongly read with (fixed values); those of other scripts apart.
LATIN = ("latin-1", "cp1252", "cp1254", "cp1250", "iso8859-9", "mac-roman", "mac-turkish", "cp857", "cp850", "cp437", "cp852")
OTHER_SCRIPTS = ("cp1251", "cp1253", "cp866", "koi8-r", "iso8859-5", "iso8859-7")
WRONG = LATIN + OTHER_SCRIPTS
RIGHT = ("utf-8", "cp1254", "iso8859-9")
#: The rest class stands for about a thousand characters, each of them that much rarer.
_REST_COST = float(np.log(1000))
LOST = "\ufffd"
#: What needs no look: ASCII, which no wrong encoding gives for another letter, Turkish letters, combining
#: marks, spaces and invisible characters. Ranges come first, as they are what is tried first.
_USUAL = "\u00a0\u00ad\u0300-\u036f\u2000-\u200f\u202f\u2060\u3000\ufeff" + "".join(c for c in TURKISH if c > "\x7f")
_EVIDENCE = re.compile(f"[^\x00-\x7f{_USUAL}]")
#: Texts without any of it, nor a question mark, which may stand for a lost letter. One anchored run
#: costs Spark less than half of a search for the opposite.
USUAL = f"^[\\x00-\\x3e\\x40-\\x7f{_USUAL}]*+\\z"
_INNER_MARK = re.compile(r"(?<=[^\W\d_])\?(?=[^\W\d_])|(?<![\w?!.)\"'])\?(?=[a-zçğıöşüâîû])|(?<=[^\W\d_])\?(?=[ ,;:)][\sa-zçğıöşüâîû(])|(?<=[^\W\d_])\?(?=[,;:.)])")
_LETTER, _ASCII_LETTER = re.compile(r"[^\W\d_]"), re.compile("[A-Za-z]")
#: Letters that wrong encodings lose (fixed values).
LOSABLE = "çğıöşüâîûÇĞİÖŞÜÂÎÛ"

#: One step reads the bytes of a wrong encoding by a right one. Chains have one step, or two of which one
#: decodes UTF-8: two steps between single-byte encodings are but another such step.
STEPS = tuple((w, r) for w, r in itertools.product(WRONG, RIGHT) if w != r)
CHAINS = [(x,) for x in STEPS] + [(x, y) for x, y in itertools.product(STEPS, STEPS) if "utf-8" in (x[1], y[1])]


def _bytes_of(codec: str) -> dict[str, int]:
    """The byte of each character in a single-byte codec; code points below 256 that it lacks stand for
    themselves."""
    table = {chr(i): i for i in range(256)}
    for i in range(256):
        try:
            table[bytes([i]).decode(codec)] = i
        except UnicodeDecodeError:
            pass
    return table


_BYTES = {codec: _bytes_of(codec) for codec in WRONG}


def _after(text: str, last: str | None = None) -> list[tuple[str, tuple[str, str]]]:
    """What each step makes of a text, with the step; ``last`` keeps to steps that decode it."""
    out, odd = [], {c for c in text if c > "\x7f"}
    for wrong, table in _BYTES.items():
        if not odd <= table.keys():
            continue
        data = bytes([table[c] for c in text])
        for right in RIGHT if last is None else (last,):
            if right != wrong:
                try:
                    read = data.decode(right)
                except UnicodeDecodeError:
                    continue
                if read != text:
                    out.append((read, (wrong, right)))
    return out


def apply_chain(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text re-encoded and decoded along the chain; None where a step can't be taken."""
    for wrong, right in chain:
        table = _BYTES[wrong]
        try:
            text = bytes([table[c] for c in text]).decode(right)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def candidates(piece: str, twice: bool, written: bool = False) -> set[str]:
    """Every text that a chain makes of a piece, as far as the model knows its characters.

    What another script's single-byte encoding gives counts only for pieces that mix scripts, and only
    in Turkish letters: else sound words of that script would be read as Turkish. Of a piece that is
    Turkish but for its ``written`` form only chains that decode UTF-8 count."""
    mixes = bool(_ASCII_LETTER.search(piece))
    once = _after(piece)
    found = {out for out, step in once if _KNOWN.fullmatch(out) and (step[1] == "utf-8" or (not written and (step[0] in LATIN or (mixes and _PLAIN_TURKISH.fullmatch(out)))))}
    if twice:
        for out, step in dict(once).items():
            found |= {o for o, _ in _after(out, None if step[1] == "utf-8" else "utf-8") if _KNOWN.fullmatch(o)}
    return found


def usual_form(piece: str) -> str:
    """The piece with look-alikes, compatibility forms and invisible characters in their usual form."""
    return "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKC", piece) if unicodedata.category(c) != "Cf")


def damage(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The opposite of ``apply_chain``: how the text looks when read wrongly."""
    for wrong, right in reversed(chain):
        try:
            text = text.encode(right).decode(wrong)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
    return text


@dataclass(frozen=True)
class Model:
    """Log probabilities of a character after two others."""

    table: np.ndarray
    margin: float

    def score(self, text: str) -> float:
        """Log probability of the text between two spaces."""
        i = _INDEX[np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        rest = int((i == _SIZE - 1).sum())
        return float(self.table[(i[:-2] * _SIZE + i[1:-1]) * _SIZE + i[2:]].sum()) - _REST_COST * rest

    def likeliest(self, piece: str) -> str:
        """The likeliest candidate for a run of text, or the run itself."""
        usual = usual_form(piece)
        written = usual != piece and bool(_PLAIN_TURKISH.fullmatch(usual))
        best, bar = piece, max(self.score(piece), self.score(usual) if written else -np.inf) + self.margin
        for twice in (False, True):
            for candidate in sorted(candidates(piece, twice, written)):
                if (s := self.score(candidate)) > bar:
                    best, bar = candidate, s
            if best != piece and not _EVIDENCE.search(best):
                break
        return best

    def gain_of_letters(self, word: str) -> float:
        """How much likelier a word is with the best letter in the place of each lost one."""
        plain, filled = word.replace(LOST, "?"), word.replace(LOST, "?")
        for _ in range(plain.count("?")):
            at = filled.index("?") if "?" in filled else -1
            if at < 0:
                break
            filled = max((filled[:at] + c + filled[at + 1 :] for c in LOSABLE), key=self.score)
        return self.score(filled) - self.score(plain)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        # Words are scored one by one: each is learnt behind two spaces, as at the start of a text.
        text = "".join(f"  {' '.join(t.split())} ".replace(" ", "  ") for t in batch.column(0).to_pylist())
        if text:
            i = _INDEX[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            total += np.bincount((i[:-2] * _SIZE + i[1:-1]) * _SIZE + i[2:], minlength=_SIZE**3)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])


#: Pairs and signs that wrong decodings leave; rows with one are not learnt from (fixed values).
TRACES = (
    "[\u0080-\u009f\ufffd√≈ƒ∂├─┼╝▒░ĂĹ]|[ÂÃÄÅ][^\u0000-\u007f]|[ýðþÝÞÐ](?s:.*)[ýðþÝÞÐ]"
    r"|[A-Za-zÇĞİÖŞÜçğıöşü]\?[A-Za-zÇĞİÖŞÜçğıöşü]"
)


#: One of how many clean rows is held out to set the margin; the step of the histogram of gains.
HELD_OUT, GAIN_STEP = 20, 0.25


def train(texts: DataFrame, text_col: str) -> Model:
    """A model of all clean rows of a column; the counts are bounded by the alphabet, not by the rows.

    A row is clean if it shows no trace of a wrong decoding (``TRACES``)."""
    rows = texts.select(F.col(text_col).cast("string").alias("t")).dropna()
    held = F.pmod(F.xxhash64("t"), F.lit(HELD_OUT)) == 0
    clean = F.col("t").rlike(USUAL) | ~F.col("t").rlike(TRACES)
    counted = rows.filter(~held).filter(clean).mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(_SIZE**3)
    if counted.num_rows:
        three[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    three = three.reshape(_SIZE, _SIZE, _SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    single = (one + 0.5) / (one.sum() + 0.5 * _SIZE)
    double = (two + 5.0 * single) / (two.sum(axis=1, keepdims=True) + 5.0)
    triple = (three + 5.0 * double[None]) / (three.sum(axis=2, keepdims=True) + 5.0)
    table = np.log(triple).ravel().astype(np.float32)
    return Model(table, validated_margin(rows.filter(held).filter(clean), Model(table, 0.0)))


#: Sound foreign words with unusual letters, which clean rows may lack (fixed values).
_SOUND = "Côte São SÃO TOMÉ Málaga Façade Crème Český Łódź Württemberg Ålesund Þingeyri Åland HÂKİM MAHKÛM 3½ 10⁻³ m² °C".split()


def _gains(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Histograms of what the words of clean rows gain: by being read otherwise, and by being repaired
    after each chain has damaged them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, cells = known.value, set(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in set(_TOKEN.findall(text)) - seen:
                    if word.isascii() or _EVIDENCE.search(word) or not _KNOWN.fullmatch(word):
                        continue
                    seen.add(word)
                    score = model.score(word)
                    gains = [("sound", model.score(c) - score) for c in candidates(word, True)]
                    gains += [("damaged", score - model.score(d)) for chain in CHAINS[: len(STEPS)] if (d := damage(word, chain)) and d != word]
                    cells.update((kind, int(np.floor(g / GAIN_STEP))) for kind, g in gains)
            if len(seen) > 200_000:
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cells], pa.string()), pa.array([c for _, c in cells], pa.int32()), pa.array(list(cells.values()), pa.int64())], ["kind", "cell", "n"])

    return measure


def validated_margin(held_out: DataFrame, model: Model) -> float:
    """A quarter of the way from the greatest gain of a sound word to the gain that all but one in a
    thousand damaged words of held-out clean rows have; 1 at least."""
    known = held_out.sparkSession.sparkContext.broadcast(model)
    rows = held_out.mapInArrow(_gains(known), "kind string, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    sound = max((model.score(c) - model.score(w) for w in _SOUND for c in candidates(w, True)), default=0.0)
    sound = max([0.0, sound, *[(r.cell + 1) * GAIN_STEP for r in rows if r.kind == "sound"]])
    damaged = sorted((r.cell, r.n) for r in rows if r.kind == "damaged")
    total, below, low = sum(n for _, n in damaged), 0, sound + 8.0
    for cell, n in damaged:
        below += n
        if below * 1000 > total:
            low = cell * GAIN_STEP
            break
    return float(max(1.0, sound + 0.25 * (low - sound)))


_TOKEN = re.compile(r"[^ \n\t]+")
_KNOWN = re.compile("[" + re.escape(ALPHABET) + "]+")
_PLAIN_TURKISH = re.compile("[" + re.escape(TURKISH) + "]+")


class Repairer:
    """Judges texts by a model, with a bounded memory of the pieces seen."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, {}

    def piece(self, piece: str) -> str:
        fixed = self.pieces.get(piece)
        if fixed is None:
            if len(self.pieces) > 200_000:
                self.pieces.clear()
            parts = re.split(f"({LOST}+)", piece)
            fixed = self.pieces[piece] = "".join(self.model.likeliest(p) if p and LOST not in p and _EVIDENCE.search(p) else p for p in parts)
        return fixed

    def lost(self, text: str) -> bool:
        """Whether letters are lost: a mark stands where one belongs, and a letter is likelier there."""
        if LOST in text:
            return True
        if "?" not in text:
            return False
        for m in _INNER_MARK.finditer(text):
            a, b = m.start(), m.end()
            while a and not text[a - 1].isspace():
                a -= 1
            while b < len(text) and not text[b].isspace():
                b += 1
            if self.model.gain_of_letters(text[a:b]) > 0:
                return True
        return False

    def repair(self, text: str) -> tuple[bool, str]:
        lost = self.lost(text)
        if not _EVIDENCE.search(text):
            return lost, text
        fixed = _TOKEN.sub(lambda m: self.piece(m.group()) if _EVIDENCE.search(m.group()) else m.group(), text)
        return lost or fixed != text, fixed


def repair(text: str, model: Model) -> tuple[bool, str]:
    """Whether the text is damaged anywhere, and the text as far as it can be restored.

    Pieces between plain spaces are judged one by one, so a text may be damaged in part. Lost letters
    stay as U+FFFD or '?'."""
    return Repairer(model).repair(text)


def restored(rows: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """``id_col, text_col, hasarli, duzeltilmis``: each row with the verdict and the restored text.

    Null texts are sound and stay null; empty ones too; repeated rows count each."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(known.value)
        for batch in batches:
            verdicts = [repairer.repair(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v for v, _ in verdicts], pa.bool_()), pa.array([t for _, t in verdicts], pa.string())],
                ["_id", "_text", "hasarli", "duzeltilmis"],
            )

    source = rows.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(source.dtypes)["_id"]
    # Texts of usual characters without a question mark stay in the JVM.
    unusual = F.coalesce(~F.col("_text").rlike(USUAL), F.lit(False))
    judged = source.filter(unusual).mapInArrow(judge, f"_id {kind}, _text string, hasarli boolean, duzeltilmis string")
    done = judged.unionByName(source.filter(~unusual).select("_id", "_text", F.lit(False).alias("hasarli"), F.col("_text").alias("duzeltilmis")))
    return done.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "hasarli", "duzeltilmis")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = spark.read.parquet(f"{sf_dir}/madde.parquet").select("kayit_no", F.col("metin").alias("metin"))
    laws = spark.read.parquet(f"{sf_dir}/mevzuat_kaydi.parquet").select("kayit_no", F.col("ad").alias("metin"))
    model = train(articles.unionByName(laws), "metin")
    parts = [restored(df, "kayit_no", "metin", model).select(F.lit(name).alias("kaynak"), "*") for name, df in (("madde", articles), ("mevzuat_kaydi", laws))]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text was in part read with a wrong encoding."""
    return _both(spark, sf_dir).filter("hasarli").select("kaynak", "kayit_no")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged rows with the text as far as it can be restored."""
    return _both(spark, sf_dir).filter("hasarli").select("kaynak", "kayit_no", "duzeltilmis")
