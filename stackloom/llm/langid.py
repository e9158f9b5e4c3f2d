"""Languages of documents and of their stretches.

A multinomial naive Bayes model over hashed character n-grams is fitted on a
bounded sample of labelled texts. Its matrix of log probabilities (BUCKETS rows,
one column a language) is broadcast; batches of sentences are scored in numpy by
adding the rows of the n-grams that occur. Sentences of a document are then read
together: changing the language from one to the next costs SWITCH, so that a
short or unclear sentence follows its neighbours. Identifiers, code and stack
lines are blanked out first; they are no prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Rows of the model: n-grams are hashed to so many buckets.
BUCKETS = 1 << 16
#: Lengths of the n-grams.
ORDERS = (1, 2, 3, 4)
#: Labelled texts used at most, spread over the sample by hash.
SAMPLE_LIMIT = 20_000
#: Additive smoothing of bucket counts.
SMOOTHING = 0.02
#: Log-probability cost of a change of language between sentences.
SWITCH = 6.0
#: Share of a document's prose from which on a language counts, and letters that make prose at all.
MIN_SHARE, MIN_LETTERS = 0.05, 8
#: Nats per letter that a model of limited data overstates; confidence is tempered by it.
TEMPER = 8.0

# ISO 639-1 codes with the other codes and the names by which labels give them.
LANGUAGE_NAMES = {
    "en": "eng english anglais englisch",
    "de": "deu ger german deutsch allemand",
    "fr": "fra fre french français francais französisch",
    "es": "spa spanish español espanol castellano castilian",
    "it": "ita italian italiano",
    "pt": "por portuguese português portugues",
    "nl": "nld dut dutch nederlands flemish",
    "ru": "rus russian русский",
    "ja": "jpn japanese 日本語",
    "zh": "zho chi chinese mandarin 中文 汉语 漢語 cmn",
}
# Codes by which a label says that it names no language.
NO_LANGUAGE = ["und", "zxx", "mul", "mis", "unk", "nan", "nil"]

# Identifiers, calls, paths, addresses and stack lines. Every repeat that another part may follow is possessive, so that a
# plain word is read once, and the parts that start at a word share one test of what stands before it.
_AFTER = "(?![A-Za-z0-9_À-ɏ])"
_CODE = re.compile(
    r"```[a-z]*|`[^`\n]*`"
    r"|^(?:[^\w\n]*(?i:file) \"[^\"\n]*\", (?i:line) \d+.*$"
    r"|[ \t]*(?:at|in|from) \S+[ \t]*\(.*\)[ \t]*$"
    r"|[ \t]*#\d+[ \t]+0[xX][0-9a-fA-F]+.*$"
    r"|[ \t]*Traceback .*$)"
    r"|https?://\S+"
    r"|<(?:locals|lambda|module)>"
    r"|(?<![A-Za-z0-9_$<>./\-À-ɏ])[./]*+(?:[A-Za-z0-9_$<>-]++(?:[./\\;:#=@]+[A-Za-z0-9_$<>()-]+)+"
    r"|[A-Z]*+[a-z]++[A-Z][A-Za-z0-9]*+" + _AFTER + r"|[A-Za-z0-9]*+_[A-Za-z0-9_]*+" + _AFTER + r")"
    r"|[0-9][0-9.,:]*[ \t]*(?:ms|us|ns|s|kb|mb|gb|%)?(?![a-zA-Z])",
    re.MULTILINE,
)
_SENTENCE = re.compile(r"[^.!?。！？…\n]+(?:[.!?。！？…]+(?=\s|$|[\"')»”’]|(?<=[。！？]))|\n|$|[.!?…]+)")
_LETTER, _WIDE = re.compile(r"[^\W\d_]"), re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_LETTERS, _BEYOND_LATIN = re.compile(r"[^\W\d_]+"), re.compile("[\u0400-\u052f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_CYRILLIC, _OTHER = re.compile("[\u0400-\u052f]"), re.compile("[^\\W\\d_\u0400-\u052f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_COMPOUND = re.compile(r"(?<![A-Za-z0-9_$<>\-À-ɏ])[a-z]++(?:-[a-z]++)+" + _AFTER)
_MARKS = str.maketrans("áàâãäåéèêëíìîïóòôõöúùûüñçýÿăőű", "aaaaaaeeeeiiiiooooouuuuncyyaou")
#: N-grams that are scored at once, so that their weights stay in a core's cache.
BLOCK = 1 << 15


def blank_code(text: str) -> str:
    """The text with everything that is no prose blanked out; positions stay."""
    return _CODE.sub(lambda m: " " * len(m.group()) if "\n" not in m.group() else re.sub(r"[^\n]", " ", m.group()), text)


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, prose) of each sentence that has letters."""
    prose = blank_code(text)
    out = []
    for m in _SENTENCE.finditer(prose):
        words = " ".join(m.group().split())
        if _LETTER.search(words):
            out.append((m.start(), m.end(), words))
    return out


def evidence(prose: str) -> str:
    """What of a sentence is scored: letters of its main script, without compounds of lower-case words.

    Words of another script than most of a sentence are names in it, and compounds
    such as ``mail-relay`` are as often names as words. Both stay prose of the
    sentence's language; where nothing else is left they are scored.
    """
    text = prose
    if _BEYOND_LATIN.search(prose):
        wide, cyrillic = 2.5 * len(_WIDE.findall(prose)), len(_CYRILLIC.findall(prose))
        latin = len("".join(_LETTERS.findall(prose))) - 0.4 * wide - cyrillic
        most = max(wide, cyrillic, latin)
        for weight, letters in ((wide, _WIDE), (cyrillic, _CYRILLIC), (latin, _OTHER)):
            if weight < most:
                text = letters.sub(" ", text)
    if "-" not in text:
        return text if text is prose or _LETTER.search(text) else prose
    text = _COMPOUND.sub(" ", text)
    return text if _LETTER.search(text) else prose


def _letters(text: str) -> int:
    """Letters, an ideograph or kana counted as two and a half, as it stands for as much prose."""
    count = len("".join(_LETTERS.findall(text)))
    return int(count + 1.5 * len(_WIDE.findall(text))) if _BEYOND_LATIN.search(text) else count


def ngram_buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams (text number, bucket) of every n-gram of every text, texts in order, by hashing code points in numpy."""
    joined = "\0".join(f" {t.lower()} " for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 0) - (points == 0)
    ok = np.ones(len(points), bool)
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        last = points[n - 1 :]
        ok = ok[:size] & (last != 0)
        value = (value[:size] * np.uint64(0x100000001B3)) ^ (last + np.uint64(n << 24))
        if n in ORDERS:
            keep = ok if n > 1 else ok & (points[:size] > 32)
            mixed = value[keep] * np.uint64(0x9E3779B97F4A7C15)
            yield owner[:size][keep], ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, float32; each row's mean is zero, so what no language has seen adds nothing

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text under each language, up to a common term."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), 500):
            for owner, bucket in ngram_buckets(texts[at : at + 500]):
                for i in range(0, len(owner), BLOCK):
                    mine = owner[i : i + BLOCK]
                    starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    out[at + mine[starts]] += np.add.reduceat(self.weights[bucket[i : i + BLOCK]], starts, axis=0)
        return out


def train(samples: DataFrame, text_col: str, lang_col: str, limit: int = SAMPLE_LIMIT) -> Model:
    """Fit on at most ``limit`` labelled texts (chosen by hash of the text, so the choice is stable).

    Every text counts once as it is and once without accents, because documents
    lose theirs. Each language gets the same prior, and the counts of each length
    of n-grams are scaled to the same total in every language: else a language
    with less text would be the likelier one for every n-gram none has seen.
    Labels that name no language are left out.
    """
    rows = samples.select(F.col(text_col).alias("t"), iso_code(F.col(lang_col)).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    got = rows.orderBy(F.xxhash64("t"), "t", "l").limit(limit).collect()  # bounded by the parameter
    languages = sorted({r["l"] for r in got})
    if not languages:
        raise ValueError("no labelled text to fit on")
    counts = np.zeros((len(ORDERS), len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        texts = [evidence(s) for r in got if r["l"] == lang for _, _, s in sentences(r["t"])]
        texts += [t.lower().translate(_MARKS) for t in texts]
        for order, (_, bucket) in enumerate(ngram_buckets(texts) if texts else ()):
            counts[order, i] = np.bincount(bucket, minlength=BUCKETS)
    totals = counts.sum(axis=2, keepdims=True)
    scale = totals.mean(axis=1, keepdims=True) / np.maximum(totals, 1)
    logs = np.log((counts * scale).sum(axis=0) + SMOOTHING)
    return Model(languages, np.ascontiguousarray((logs - logs.mean(axis=0)).T, dtype=np.float32))


def _path(scores: np.ndarray) -> np.ndarray:
    """Most probable language of each sentence when a change costs SWITCH."""
    n, _ = scores.shape
    best, back = scores[0].copy(), np.zeros(scores.shape, np.int64)
    for i in range(1, n):
        lead = int(best.argmax())
        change = best[lead] - SWITCH
        back[i] = np.where(best >= change, np.arange(len(best)), lead)
        best = np.maximum(best, change) + scores[i]
    out = np.empty(n, np.int64)
    out[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _confidence(scores: np.ndarray, chosen: np.ndarray, letters: np.ndarray) -> np.ndarray:
    tempered = (scores - scores.max(axis=1, keepdims=True)) / np.maximum(TEMPER, letters[:, None] / TEMPER)
    odds = np.exp(tempered)
    return odds[np.arange(len(scores)), chosen] / odds.sum(axis=1)


_SPANS = "prose bigint, spans array<struct<start: int, stop: int, lang: string, letters: int, confidence: double>>"


def segments(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, prose (letters of prose), spans (the stretches of one language, in order), and the columns of ``keep``.

    Whole texts are scored, in one narrow pass. A null text, and one without
    prose, has no spans. Positions are characters of the text as delivered.
    """
    keep = keep or []
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for pdf in batches:
            cut = [sentences(t) if t else [] for t in pdf["t"]]
            texts = [s for c in cut for _, _, s in c]
            scores = fitted.score([evidence(s) for s in texts]) if texts else np.zeros((0, len(fitted.languages)))
            sizes = np.array([_letters(s) for s in texts], np.int64)
            spans, prose, at = [], [], 0
            for c in cut:
                mine, letters = scores[at : at + len(c)], sizes[at : at + len(c)]
                at += len(c)
                total = int(letters.sum()) if len(c) else 0
                prose.append(total)
                spans.append(_spans(c, mine, letters, fitted.languages) if total >= MIN_LETTERS else [])
            yield pd.DataFrame({"doc_id": pdf["i"], "prose": prose, "spans": spans, **{c: pdf[c] for c in keep}})

    kinds = dict(documents.dtypes)
    schema = f"doc_id {kinds[id_col]}, {_SPANS}" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    return documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), *keep).mapInPandas(run, schema)


def _spans(cut: list[tuple[int, int, str]], scores: np.ndarray, letters: np.ndarray, languages: list[str]) -> list[dict]:
    chosen = _path(scores)
    starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    stops = np.r_[starts[1:], len(chosen)]
    sums = np.add.reduceat(scores, starts, axis=0)
    sizes = np.add.reduceat(letters, starts)
    sure = _confidence(sums, chosen[starts], sizes)
    return [
        {"start": cut[a][0], "stop": cut[b - 1][1], "lang": languages[chosen[a]], "letters": int(n), "confidence": float(p)}
        for a, b, n, p in zip(starts, stops, sizes, sure)
    ]


def written_in() -> Column:
    """Of a row of ``segments``: the languages from MIN_SHARE of the prose on, as array of lang, share, confidence (weighted by letters), sorted."""
    mine = "filter(spans, s -> s.lang = l)"
    total = lambda what: f"aggregate({mine}, cast(0 as double), (a, s) -> a + {what})"
    each = F.expr(f"transform(array_sort(array_distinct(spans.lang)), l -> named_struct('lang', l, 'share', {total('s.letters')} / prose, 'confidence', {total('s.letters * s.confidence')} / greatest({total('s.letters')}, 1D)))")
    return F.filter(each, lambda x: x["share"] >= MIN_SHARE)


def document_languages(found: DataFrame) -> DataFrame:
    """doc_id, lang, share, confidence: the languages each row of ``segments`` is written in; nothing is shuffled."""
    return found.select("doc_id", F.explode(written_in()).alias("x")).select("doc_id", "x.*")


def iso_code(label: Column, names: dict[str, str] | None = None) -> Column:
    """ISO 639-1 code of a label in any usual spelling, with or without region; null where it names no language.

    Spellings of the languages in ``names`` (LANGUAGE_NAMES if not given) are
    brought to their code; any other code of two or three letters stays as it is.
    """
    table_of = {name: lang for lang, others in (names or LANGUAGE_NAMES).items() for name in [lang, *others.split()]}
    table = F.create_map(*[F.lit(x) for pair in sorted(table_of.items()) for x in pair])
    word = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    main = F.regexp_extract(word, r"^([^-_.\s(]+)", 1)
    return F.coalesce(table[word], table[main], F.when(main.rlike("^[a-z]{2,3}$") & ~main.isin(NO_LANGUAGE), main))
