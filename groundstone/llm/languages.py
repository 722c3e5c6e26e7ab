"""Languages of documents and of the stretches inside them (problem 10).

Compression classification: every language has a zstandard compressor whose raw-content dictionary
is text of that language; a sentence belongs to the language whose compressor makes it smallest.
The dictionaries are fitted on a bounded sample of labelled documents; wrong labels in the sample
are found by the same classifier, each half of the sample judging the other.  A sentence whose best
and second-best sizes lie close together is rejected and takes the language of its neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from groundstone.llm.glyphs import parts

# ISO 639-1 code, ISO 639-2 codes, English name, own name.
_LANGUAGES = """
en eng english english|de deu,ger german deutsch|fr fra,fre french français|es spa spanish español|it ita italian italiano|pt por portuguese português
nl nld,dut dutch nederlands|ru rus russian русский|hi hin hindi हिन्दी|zh zho,chi,cmn chinese 中文|ja jpn japanese 日本語|ko kor korean 한국어
ar ara arabic العربية|sv swe swedish svenska|da dan danish dansk|no nor norwegian norsk|fi fin finnish suomi|pl pol polish polski
cs ces,cze czech čeština|sk slk,slo slovak slovenčina|hu hun hungarian magyar|ro ron,rum romanian română|bg bul bulgarian български|uk ukr ukrainian українська
el ell,gre greek ελληνικά|tr tur turkish türkçe|he heb hebrew עברית|fa fas,per persian فارسی|bn ben bengali বাংলা|ta tam tamil தமிழ்
te tel telugu తెలుగు|mr mar marathi मराठी|gu guj gujarati ગુજરાતી|ur urd urdu اردو|th tha thai ไทย|vi vie vietnamese tiếng_việt
id ind indonesian bahasa_indonesia|ms msa,may malay bahasa_melayu|ca cat catalan català|hr hrv croatian hrvatski|sr srp serbian српски|sl slv slovenian slovenščina
""".strip().replace("\n", "|")
# Labels that name no language; the first are right for a text without sentences.
UNDETERMINED = frozenset(["und", "undetermined", "zxx"])
NO_LANGUAGE = frozenset(["", "unk", "unknown", "xx", "xxx", "mul", "mis", "none", "null", "nan", "n/a", "na", "n.a.", "?", "??", "???", "-", "--", "other", "other language", "tbd", "auto", "multi", "multiple", "mixed"])

#: The sample that dictionaries are fitted on: documents a language, characters of each, bytes of a
#: dictionary, and the least that makes a language (a code of two letters).
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 80, 4_000, 48_000
LEAST_DOCUMENTS, LEAST_SENTENCES, MAX_LANGUAGES = 3, 12, 26 * 26
#: A sentence is rejected when the second-best size is within this share of the best.
MARGIN = 0.04
#: Every sentence is compressed with every dictionary at the first level; where the second-best size
#: is within CLOSE of the best, again with every dictionary at the second, whose search is finer.
LEVEL, FINE_LEVEL, CLOSE = -1, 3, 0.12
#: A sentence's text and its words, both in lower case: letter case is no sign of a language.
Sentence = tuple[str, list[str]]


@lru_cache(1)
def _names() -> dict[str, str]:
    out: dict[str, str] = {}
    for entry in _LANGUAGES.split("|"):
        code, three, name, own = entry.split(" ")
        for x in (code, *three.split(","), name, own.replace("_", " ")):
            out[x] = code
    return out


@lru_cache(100_000)
def code_of(label: str | None) -> str | None:
    """ISO 639-1 code of a label in any notation; None if it names no language; an unknown label stays
    itself in lower case, since it is some language's or none's but not the text's."""
    low = (label or "").strip().lower()
    if low in NO_LANGUAGE or low in UNDETERMINED or not any(c.isalpha() for c in low):
        return None
    names = _names()
    head = re.split(r"[-_ (;,/.]", low, maxsplit=1)[0]
    return names.get(low) or names.get(head) or low


def _codes(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: code_of(x) if isinstance(x, str) else None)


# Closing marks that need white space (or closing quotation marks) after them, those that don't,
# and quotation marks and brackets that may stand after either; in Greek the semicolon asks.
_STOPS, _FULL_STOPS, _CLOSERS = ".!?؟۔", "।॥。！？｡๚๛", "\"”“’‘)\\]»«》」』"
_ASKS = r"[;\u037e](?<=[Ͱ-Ͽἀ-῿].)"
_AFTER = rf"(?=[{_CLOSERS}]*(?:\s|$))"
_QUOTED = re.compile(r"[“„«《「『][^“”„«»《》「」『』\n]*[”“»》」』]|(?<![\w])\"[^\"\n]*\"(?!\w)")
_BREAK = re.compile(rf"(?=[{_STOPS}{_FULL_STOPS};\u037e\n])(?:(?:[{_STOPS}]|{_ASKS}){_AFTER}|[{_FULL_STOPS}])[{_STOPS}{_FULL_STOPS}]*[{_CLOSERS}]*\s*|\n[^\S\n]*\n\s*")
_ENDS = re.compile(rf"[{_STOPS}{_FULL_STOPS};\u037e][{_CLOSERS}\s]*$")


def _marks(least: int) -> str:
    """Ranges of combining marks of scripts with spaces, for a character class."""
    held = [cp for cp in range(least, 0x20000) if unicodedata.category(chr(cp)) in ("Mn", "Mc") and not re.match(f"[{_UNSPACED}]", chr(cp))]
    runs = [[cp for _, cp in group] for _, group in groupby(enumerate(held), lambda x: x[1] - x[0])]
    return "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)


_UNSPACED = "぀-鿿฀-๿"
_LETTERS, _MARKS = rf"[^\W\d_{_UNSPACED}]", f"[{_marks(0x300)}]"
#: Words with their vowel signs and other marks; a letter of a script that puts no spaces between words is one of its own.
#: A letter with a vowel sign is a word; one with an accent that is coded by itself is none, as the composed letter.
_TOKEN = re.compile(rf"[{_UNSPACED}]|{_LETTERS}{{2,}}(?:{_MARKS}+{_LETTERS}*)*|{_LETTERS}[\u0300-\u036f]*(?:{_LETTERS}|[{_marks(0x370)}])(?:{_LETTERS}|{_MARKS})*")
_ASCII_WORD = re.compile("[a-z]{2,}")  # the same words of plain text
_FIGURES = re.compile(r"[-+]?\d[\d.,]*%?|\|")


def sentences(text: str) -> Iterator[tuple[int, int, Sentence | None]]:
    """(start, end, what is classified) of the stretches between closing marks or blank lines.

    A single line end may stand inside a sentence.  A whole sentence has its closing mark and at
    least three words (or four letters of a script without spaces) outside quoted titles; other
    stretches give None.  A quotation that is a whole sentence itself is a stretch of its own.
    """
    at = 0
    for m in _BREAK.finditer(text):
        if not _ENDS.search(m.group()):
            yield at, m.end(), None
        elif quoted := [q for q in _quotations(text[at : m.end()]) if _ENDS.search(q.group()[:-1]) and _whole(q.group()[1:-1])]:
            yield from _around(text[at : m.end()], at, [q.span() for q in quoted])
        else:
            yield at, m.end(), _whole(text[at : m.end()])
        at = m.end()
    if at < len(text):
        yield at, len(text), None


def _around(piece: str, at: int, quoted: list[tuple[int, int]]) -> Iterator[tuple[int, int, Sentence | None]]:
    """The stretches of a piece with quoted sentences; what stands around them is one sentence, given
    with its longest part."""
    edges = [0, *(x for span in quoted for x in span), len(piece)]
    outer = list(zip(edges[::2], edges[1::2]))
    longest = max(outer, key=lambda x: x[1] - x[0])
    rest = _whole(" ".join(piece[a:b] for a, b in outer))
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield at + a, at + b, _whole(piece[a + 1 : b - 1]) if (a, b) in quoted else rest if (a, b) == longest else None


def _whole(piece: str) -> Sentence | None:
    """What is classified of a piece, if it has a sentence's words."""
    body = bare(piece).lower()
    words = (_ASCII_WORD if body.isascii() else _TOKEN).findall(body)
    return (body, words) if len(words) > 3 or len(words) == 3 and all(len(w) > 1 for w in words) else None


def _quotations(piece: str) -> Iterator[re.Match]:
    return _QUOTED.finditer(piece) if any(q in piece for q in "“„«《「『\"") else iter(())


def bare(piece: str) -> str:
    """What is classified: without quoted titles, figures and table rules, white space collapsed."""
    if any(q in piece for q in "“„«《「『\""):
        piece = _QUOTED.sub(" ", _QUOTED.sub(" ", piece))  # a title may hold another
    return " ".join(_FIGURES.sub(" ", piece).split())


class Classifier:
    """Compressors with a raw-content dictionary per language; every sentence meets them all."""

    def __init__(self, samples: dict[str, list[str]]):
        import zstandard as z

        self.codes: list[str] = []
        self.quick, self.fine = [], []
        for code in sorted(samples):
            # in an order that mixes the documents, so that the part that fits is from many of them
            held = [s.encode("utf-8", "replace") for s in samples[code]]
            raw = b" ".join(sorted(held, key=lambda s: blake2b(s, digest_size=8).digest()))[-DICTIONARY_BYTES:]
            if len(raw) < 64:
                continue
            self.codes.append(code)
            for level, out in ((LEVEL, self.quick), (FINE_LEVEL, self.fine)):
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                out.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    @staticmethod
    def _ranked(compressors: list, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The compressor that makes each smallest, and how far the second best is behind, as a share of the best."""
        sizes = np.empty((len(compressors), len(data)), np.int32)
        for i, compress in enumerate(compressors):
            sizes[i] = np.fromiter(map(len, map(compress, data)), np.int32, len(data))
        sizes = np.maximum(sizes - 6, 1)  # a frame's fixed bytes say nothing
        best = sizes.argmin(0)
        if len(compressors) == 1:
            return best, np.ones(len(data))
        two = np.partition(sizes, 1, axis=0)[:2]
        return best, (two[1] - two[0]) / two[0]

    def best(self, sentences: list[Sentence]) -> tuple[list[str | None], np.ndarray]:
        """The language of every sentence, and its margin over the second best of all."""
        if not self.codes or not sentences:
            return [None] * len(sentences), np.zeros(len(sentences))
        data = [body.encode("utf-8", "replace") for body, _ in sentences]
        best, margin = self._ranked(self.quick, data)
        close = np.flatnonzero(margin < CLOSE)
        if len(close):
            best[close], margin[close] = self._ranked(self.fine, [data[i] for i in close.tolist()])
        return [self.codes[i] for i in best.tolist()], margin


def _trusted(docs: list[tuple[str, list[Sentence]]]) -> list[tuple[str, list[Sentence]]]:
    """Documents whose words speak for their label.

    Every word votes for the label in whose documents it is most frequent, so the few documents that
    carry a label by mistake are outvoted, though a dictionary that holds even one of them would fit
    them well.
    """
    many = Counter(lang for lang, _ in docs)
    seen: dict[str, Counter] = defaultdict(Counter)
    words = [{w for _, ws in held for w in ws} for _, held in docs]
    for (lang, _), ws in zip(docs, words):
        for w in ws:
            seen[w][lang] += 1
    choice = {w: max(n, key=lambda k: (n[k] / many[k], k)) for w, n in seen.items() if n.total() > 1}
    out = []
    for (lang, held), ws in zip(docs, words):
        votes = Counter(choice[w] for w in ws if w in choice)
        if held and votes and votes[lang] == max(votes.values()):
            out.append((lang, held))
    return out


def fit(documents: DataFrame, checked: DataFrame | None = None) -> dict[str, list[str]]:
    """Sentences per language from a bounded sample of labelled rows.

    Hand-checked documents come first, then others by a hash of their id: SAMPLE_DOCUMENTS a
    language at most, SAMPLE_CHARS of each.  Documents whose words are another label's go.  The rest
    is split in halves; a sentence stays only if the other half's dictionaries give it its label.
    """
    code = F.pandas_udf(_codes, T.StringType())("lang").alias("code")
    rows = documents.where("doc_id is not null and lang is not null").select("doc_id", code, F.lit(1).alias("rank"))
    if checked is not None:
        rows = rows.unionByName(checked.where("doc_id is not null and lang is not null").select("doc_id", code, F.lit(0).alias("rank")))
    rows = rows.where(F.col("code").rlike("^[a-z]{2}$"))
    order = Window.partitionBy("code").orderBy("rank", F.xxhash64("doc_id"), "doc_id")
    picked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCUMENTS).select("doc_id", "code")
    texts = documents.where("text is not null").select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    # codes of two letters, so many documents of each: what is broadcast and fetched is bounded
    found = texts.join(F.broadcast(picked.limit(SAMPLE_DOCUMENTS * MAX_LANGUAGES)), "doc_id").distinct().collect()
    by_code: dict[str, list] = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.code, r.doc_id)):
        by_code[r.code].append(r.text)
    docs = [(lang, [found for _, _, found in sentences(text) if found]) for lang, held in by_code.items() if len(held) >= LEAST_DOCUMENTS for text in held]
    halves: list[dict[str, list[list[Sentence]]]] = [defaultdict(list), defaultdict(list)]
    for i, (lang, held) in enumerate(_trusted(docs)):
        halves[i % 2][lang].append(held)
    for _ in range(3):
        judges = [Classifier({k: [s[0] for d in v for s in d] for k, v in half.items()}) for half in halves]
        kept: list[dict[str, list[list[Sentence]]]] = [defaultdict(list), defaultdict(list)]
        for i in (0, 1):
            for lang, held in halves[i].items():
                guesses = iter(judges[1 - i].best([s for doc in held for s in doc])[0])
                for doc in held:
                    mine = [s for s in doc if next(guesses) == lang]
                    # a document whose label is wrong goes as a whole; a mixed one keeps its share
                    if 2 * len(mine) > len(doc):
                        kept[i][lang].append(mine)
        halves = kept
    flat = [{k: [s[0] for d in v for s in d] for k, v in half.items()} for half in halves]
    both = {lang: flat[0].get(lang, []) + flat[1].get(lang, []) for lang in set(flat[0]) | set(flat[1])}
    return {lang: held for lang, held in both.items() if len(held) >= LEAST_SENTENCES}


def stretches(texts: list[str], classifier: Classifier) -> Iterator[list[tuple[int, int, str, float, int]]]:
    """Per text: (start, end, language, confidence, whole sentences) of its stretches.

    Sentences in a row of one language are one stretch; what is no whole sentence, or is rejected,
    goes with the stretch before it.  A text without whole sentences is one stretch ``und``.
    """
    for first, last in parts([len(t) for t in texts]):
        cut = [list(sentences(t)) for t in texts[first:last]]
        langs, margins = classifier.best([found for held in cut for _, _, found in held if found])
        judged = zip(langs, margins.tolist())
        for text, held in zip(texts[first:last], cut):
            yield _joined(len(text), [(a, b, *(next(judged) if found else (None, 0.0))) for a, b, found in held])


def _joined(length: int, judged: list[tuple[int, int, str | None, float]]) -> list[tuple[int, int, str, float, int]]:
    out: list[list] = []
    doubtful = Counter(lang for _, _, lang, margin in judged if lang is not None and margin < MARGIN)
    for a, b, lang, margin in judged:
        if lang is None or margin < MARGIN:
            if out:
                out[-1][1] = b
        elif out and out[-1][2] == lang:
            out[-1][1] = b
            out[-1][3].append(margin)
        else:
            out.append([out[-1][1] if out else 0, b, lang, [margin]])
    if not out and doubtful:  # rejected sentences only: the most frequent guess, at no confidence
        return [(0, length, doubtful.most_common(1)[0][0], 0.0, doubtful.total())]
    if not out:
        return [(0, length, "und", 0.0, 0)]
    out[-1][1] = length
    return [(a, b, lang, round(1 - 1 / (1 + 10 * sum(m) / len(m)), 4), len(m)) for a, b, lang, m in out]


def segments(documents: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """doc_id, char_start, char_end, lang, confidence and sentences of every stretch; a null text has
    none.  A doc_id given twice gives its stretches twice, as it stands twice in the table."""
    shared = documents.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Classifier(shared.value)
        for b in batches:
            out = [(i, *s) for i, found in zip(b.doc_id, stretches(b.text.tolist(), c)) for s in found]
            yield pd.DataFrame(out, columns=["doc_id", "char_start", "char_end", "lang", "confidence", "sentences"])

    held = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return held.mapInPandas(run, "doc_id bigint, char_start int, char_end int, lang string, confidence double, sentences int")


def labels(documents: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """doc_id, old_lang, lang, confidence and languages of every document with a text.

    ``lang`` is the language of most of the text, ``languages`` lists every one in which the
    document holds a whole sentence, ``confidence`` is that of ``lang`` weighted by length.
    """
    shared = documents.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Classifier(shared.value)
        for b in batches:
            out = []
            for i, old, held in zip(b.doc_id, b.lang, stretches(b.text.tolist(), c)):
                size: dict[str, int] = defaultdict(int)
                sure: dict[str, float] = defaultdict(float)
                for a, z, lang, conf, _ in held:
                    size[lang] += z - a
                    sure[lang] += (z - a) * conf
                top = max(size, key=lambda x: (size[x], x))
                code = code_of(old) if isinstance(old, str) else None
                if top == "und" and code is None and isinstance(old, str) and old.strip().lower() in UNDETERMINED:
                    code = "und"
                out.append((i, old, top, round(sure[top] / max(size[top], 1), 4), sorted(size), code))
            yield pd.DataFrame(out, columns=["doc_id", "old_lang", "lang", "confidence", "languages", "old_code"])

    held = documents.where("doc_id is not null and text is not null").select("doc_id", "lang", "text")
    return held.mapInPandas(run, "doc_id bigint, old_lang string, lang string, confidence double, languages array<string>, old_code string")


def mislabelled(labelled: DataFrame) -> DataFrame:
    """doc_id and lang, a row per language, of documents whose label is missing or wrong or that
    hold several languages.  ``und`` is the right label of a text without sentences."""
    case = F.col("old_code").isNull() | (F.size("languages") > 1) | ~F.array_contains("languages", F.coalesce("old_code", F.lit("")))
    return labelled.where(case).select("doc_id", F.explode("languages").alias("lang")).distinct()
