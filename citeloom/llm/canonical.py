"""Typed values to the entries of a reference list.

Values here are citations: a section named by number ("the 9th article", "Art1cle XXIX", "udpr s5(2)") or by heading,
with slips of the keyboard. Each distinct value is resolved once:

1. what names a number is read as one (units, ordinals, Roman numerals, number words, confused characters);
2. the distinct tokens of the others are joined to the tokens of all headings by edit distance, over shared deletion
   variants or, of long words, shared parts (an equi-join), and checked;
3. soft TF-IDF of the repaired tokens ranks the headings of the value's framework; the best is taken if its whole text
   is within a few edits.

Values without an entry come out as ``unmatched``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage

UNMATCHED = "unmatched"
#: Least soft TF-IDF score of a heading, and the share of its characters that may differ.
MIN_SCORE, MAX_EDIT_SHARE = 0.5, 0.14
#: Words of more characters are found by their parts instead of by deletion variants, whose number grows with the square.
LONG = 24

# Words for a section, words for other units, and number words.
SECTION_WORDS = {"article", "section", "paragraph", "clause", "artikel", "seksyen", "pasal", "art", "sec", "sect", "para", "cl", "s", "arts", "ss", "§", "§§", "มาตรา", "paragraf", "fasal"}
SECTION_REPAIRED = ["article", "section", "paragraph", "clause", "artikel", "seksyen", "pasal", "มาตรา"]
OTHER_UNITS = {"schedule", "annex", "part", "chapter", "recital", "title", "appendix", "table", "form", "anhang", "anlage", "kapitel", "annexe", "chapitre", "partie", "jadual", "bahagian", "bab", "lampiran", "ภาคผนวก", "หมวด", "ส่วน", "บทที่", "volume", "book", "division", "rule", "regulation", "erwägungsgrund", "considérant"}
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
GERMAN_UNITS = "ein zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn".split()
GERMAN_TENS = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
FRENCH_UNITS = "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize".split()
FRENCH_TENS = {"vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}

_THAI = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
_CONFUSED = str.maketrans("lIO|", "1101")
_TOKEN = re.compile(r"§+|[^\W_]+(?:[ัิ-ฺ็-๎]+[^\W_]*)*")
_NUMBER = re.compile(r"[\s.:#(\[\-–]*([0-9lIO|]*[0-9][0-9lIO|]*)(?:(st|nd|rd|th)\b|[.\-]?([A-Z])(?![A-Za-z0-9])|([a-z])(?![A-Za-z0-9]))?")
_ROMAN = re.compile(r"[\s.:]*(?=[IVXLC])(C{0,3}(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))(?![A-Za-z0-9])")


def folded(value: str) -> str:
    """Compatibility forms and Thai digits folded (the Thai vowel that this takes apart is put together); case stays."""
    return unicodedata.normalize("NFKC", value).replace("\u0e4d\u0e32", "\u0e33").translate(_THAI)


def distance(a: str, b: str, most: int) -> int:
    """Edits (with exchanges of neighbours) between two words, or ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def _is_section(word: str) -> bool:
    w = word.lower()
    if w in SECTION_WORDS:
        return True
    w = w.replace("1", "i").replace("0", "o")
    return len(w) >= 5 and any(distance(w, u, 2) <= (2 if len(u) > 6 else 1) for u in SECTION_REPAIRED)


def _english(word: str) -> int | None:
    """The value of one English number word below 100, cardinal or ordinal."""
    if word in ORDINALS:
        return ORDINALS[word]
    stem = word[:-4] + "y" if word.endswith("ieth") else word[:-2] if word.endswith("th") else word
    if stem in UNITS:
        return UNITS.index(stem) + 1
    return 20 + 10 * TENS.index(stem) if stem in TENS else None


def _german(word: str) -> int | None:
    """The value of a German number word below 1000, written as one word."""
    word = re.sub(r"(?:s?te[rsnm]?)$", "", word) if re.search(r"te[rsnm]?$", word) else word
    head, hundred, rest = word.rpartition("hundert")
    total = 0
    if hundred:
        if head and head not in GERMAN_UNITS[:9]:
            return None
        total, word = 100 * (GERMAN_UNITS.index(head) + 1 if head else 1), rest.removeprefix("und")
        if not word:
            return total
    word = word.replace("ss", "ß") if word.startswith("dreiss") or "unddreiss" in word else word
    word = "ein" if word in ("eins", "eine") else word
    if word in GERMAN_UNITS:
        return total + GERMAN_UNITS.index(word) + 1
    unit, und, tens = word.rpartition("und")
    if tens in GERMAN_TENS and (not und or unit in GERMAN_UNITS[:9]):
        return total + 20 + 10 * GERMAN_TENS.index(tens) + (GERMAN_UNITS.index(unit) + 1 if und else 0)
    return None


def _french(words: list[str]) -> int | None:
    """The value of the French number words that a list begins with, below 1000."""
    total, part, read = 0, 0, False
    for i, w in enumerate(words):
        w = w.removesuffix("s") if w in ("cents", "vingts") else w
        if w == "premier" or w == "première":
            return 1
        if w == "et" and read and i + 1 < len(words) and words[i + 1] in ("un", "onze"):
            continue
        if w == "cent" and part < 10:
            total, part = total + 100 * max(1, part), 0
        elif w == "vingt" and part == 4:
            part = 80
        elif w in FRENCH_TENS and not part:
            part = FRENCH_TENS[w]
        elif w in FRENCH_UNITS and (not part or part >= 20 and part % 10 == 0 or part % 100 in (70, 90) and w in ("sept", "huit", "neuf")):
            part += FRENCH_UNITS.index(w) + 1
        else:
            break
        read = True
    return total + part if read else None


def _word_number(rest: str) -> int | None:
    """The number that a text's first words name in English, German or French, up to 999; else None."""
    words = re.findall(r"[^\W\d_]+", rest.lower())[:8]
    total, part, last = 0, 0, None
    for i, w in enumerate(words):
        if w == "and" and last == "hundred" and i + 1 < len(words) and _english(words[i + 1]) is not None:
            continue
        if w in ("hundred", "hundredth") and 0 < part < 10:
            total, part, last = 100 * part, 0, "hundred"
            continue
        n = _english(w)
        if n is None or part and not (part >= 20 and part % 10 == 0 and n < 10):
            break
        part, last = part + n, w
    if last is not None:
        return total + part
    if not words:
        return None
    german = _german(words[0])
    return german if german is not None else _french(words)


def _roman(text: str) -> int:
    total = 0
    for a, b in zip(text, text[1:] + " "):
        total += -ROMAN[a] if ROMAN.get(b, 0) > ROMAN[a] else ROMAN[a]
    return total


def _base(m: re.Match) -> tuple[str, str]:
    """The section a number match names, a letter belonging to it; and the section with a letter that looks like a digit
    read as one."""
    digits, _, capital, small = m.groups()
    number = digits.translate(_CONFUSED).lstrip("0") or "0"
    letter = capital or (small or "").upper()
    digit = letter.translate(str.maketrans("ILO", "110"))
    return number + letter, number + digit


def read_number(value: str, framework: str | None) -> tuple[str, str]:
    """('number', base section), ('other', '') for another unit, or ('text', what remains to be looked up)."""
    kind, _, out = readings(value, framework)
    return kind, out


def readings(value: str, framework: str | None) -> tuple[str, str, str]:
    """As ``read_number``, with two base sections: a last letter that looks like a digit taken as a letter, and as a digit.
    Which of them the framework has, decides."""
    s = folded(value).strip(" \t\r\n\u00a0\"'“”‘’„«»*_[]()`")
    act, _, country = (framework or "").partition("_")
    if act:
        tag = rf"(?<![A-Za-z]){re.escape(act)}(?:[_ ]{re.escape(country)})?(?![A-Za-z])" if country else rf"(?<![A-Za-z]){re.escape(act)}(?![A-Za-z])"
        s = re.sub(tag, " ", s, flags=re.I)
    s = re.sub(r"^[\s:/,;.\-–(\[\"'“*]+", "", s)
    s = re.sub(r"^(?:the|see|of)\s+", "", s, flags=re.I)
    first = _TOKEN.match(s)
    if not first:
        return "text", s, s
    word, rest = first.group(), s[first.end() :]
    glued = re.fullmatch(r"(art|sec|sect|s|cl|para|มาตรา)((?:[0-9lIO]*[0-9][0-9lIO]*)[A-Za-z]?)", word, re.I)
    if glued:
        word, rest = glued.group(1), glued.group(2) + rest
    if word.lower() in OTHER_UNITS and re.match(r"[\s.:(]*(?:[0-9]+|[IVXLC]+\b|[A-Z]\b|$)", rest):
        return "other", "", ""
    if _is_section(word):
        roman = _ROMAN.match(rest)
        number = _NUMBER.match(rest)
        if roman and roman.group(1) and not (number and len(number.group(1)) > len(roman.group(1))):
            return "number", str(_roman(roman.group(1))), str(_roman(roman.group(1)))
        if number:
            return "number", *_base(number)
        if (n := _word_number(rest)) is not None:
            return "number", str(n), str(n)
        return "text", s, s
    ordinal = _TOKEN.match(rest.lstrip())
    if ordinal and _is_section(ordinal.group()) and (n := _word_number(word)) is not None:
        return "number", str(n), str(n)
    number = _NUMBER.match(s)
    if number and (number.group(2) is None or _is_section((_TOKEN.search(s, number.end()) or first).group())):
        return "number", *_base(number)
    return "text", s, s


def heading_text(c: Column) -> Column:
    """A heading as it is compared: case folded, only letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def _variants(word: str) -> list[str]:
    """The word and what is left of it without one or two characters; how many may go depends on its length."""
    n = len(word)
    most = 0 if n < 4 else 1 if n < 6 else 2
    out = {word}
    for k in range(1, most + 1):
        for gone in combinations(range(n), k):
            out.add("".join(ch for i, ch in enumerate(word) if i not in gone))
    return sorted(out)


def _thirds(n: int) -> list[tuple[int, int]]:
    """Where the three parts of a word of ``n`` characters begin and end: two edits leave one of them as it is."""
    return [(i * n // 3, (i + 1) * n // 3) for i in range(3)]


def _word_keys(word: str) -> list[str]:
    """What a word of the vocabulary is found by: its variants, of a word of more than LONG characters its parts. The
    blanks in front, which no variant has, keep the two apart."""
    n = len(word)
    return _variants(word) if n <= LONG else [f" {n} {i} {word[lo:hi]}" for i, (lo, hi) in enumerate(_thirds(n))]


def _token_keys(token: str) -> list[str]:
    """The keys of all words that a token may be: its variants, and the parts of longer words, moved by two places at most."""
    n = len(token)
    out = set(_variants(token)) if n <= LONG + 2 else set()
    for m in range(max(LONG + 1, n - 2), n + 3):
        for i, (lo, hi) in enumerate(_thirds(m)):
            out.update(f" {m} {i} {token[lo + k : hi + k]}" for k in range(-2, 3) if 0 <= lo + k and hi + k <= n)
    return sorted(out)


def _key_rows(keys_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for w in batch.column(0).to_pylist():
                v = keys_of(w)
                a += [w] * len(v)
                b += v
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["word", "variant"])

    return run


def join_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, word, sim: each distinct token with the vocabulary words next to it by edit distance (0, 1 or 2 by length)."""
    # No cut: the distance is the difference of the lengths at least, so a token more than two characters longer than the
    # longest word has no partner.
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    left = tokens.where(F.length("token") <= longest + 2).select(F.col("token").alias("word")).distinct().mapInArrow(_key_rows(_token_keys), "word string, variant string").withColumnRenamed("word", "token")
    right = vocabulary.select("word").distinct().mapInArrow(_key_rows(_word_keys), "word string, variant string")
    near = left.join(right, "variant").select("token", "word").distinct()
    most = F.when(F.length("token") < 4, 0).when(F.length("token") < 6, 1).otherwise(2)
    # Exchanged neighbours are two edits of the built-in distance.
    near = near.withColumn("d", F.levenshtein("token", "word")).where((F.col("d") <= most) | ((F.col("d") == 2) & (F.length("token") >= 4)))
    return near.select("token", "word", (1 - F.col("d") / F.greatest(F.length("token"), F.length("word"))).alias("sim"))


def rank_headings(values: DataFrame, entries: DataFrame) -> DataFrame:
    """framework, value, citation_id: the heading of the value's framework with the best soft TF-IDF score, where its
    text is near enough to the value's. values: framework, value, text (folded)."""
    heads = entries.select("framework", "citation_id", heading_text(F.col("heading")).alias("head")).where(F.col("head") != "").distinct()
    head_tokens = heads.select("framework", "citation_id", "head", F.explode(F.array_distinct(F.split("head", " "))).alias("word"))
    n = heads.groupBy("framework").agg(F.count("*").alias("n"))
    df = head_tokens.groupBy("framework", "word").agg(F.count("*").alias("df"))
    weight = df.join(n, "framework").select("framework", "word", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    weighted = head_tokens.join(weight, ["framework", "word"])
    norm = weighted.groupBy("framework", "citation_id", "head").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weighted = weighted.join(norm, ["framework", "citation_id", "head"]).select("framework", "citation_id", "head", "word", (F.col("w") / F.col("norm")).alias("hw"), "w")
    value_tokens = values.select("framework", "value", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    repaired = value_tokens.join(join_tokens(value_tokens.select("token"), head_tokens.select("word")), "token")
    matched = repaired.join(weighted, ["framework", "word"])
    per_token = matched.groupBy("framework", "value", "text", "citation_id", "head", "token").agg(F.max(F.col("sim") * F.col("hw") * F.col("w")).alias("part"), F.max(F.col("sim") * F.col("w")).alias("vw"))
    # The value's own norm is the same for all its headings, so ranking needs the sum alone; the threshold takes the
    # share of the heading's weight that the value accounts for.
    scored = per_token.groupBy("framework", "value", "text", "citation_id", "head").agg(F.sum("part").alias("dot"), F.sqrt(F.sum(F.col("vw") * F.col("vw"))).alias("vnorm"))
    scored = scored.withColumn("score", F.when(F.col("vnorm") > 0, F.col("dot") / F.col("vnorm")).otherwise(0.0)).where(F.col("score") >= MIN_SCORE)
    edits = F.levenshtein(F.col("text"), F.col("head"))
    close = scored.withColumn("edits", edits).where(F.col("edits") <= F.greatest(F.lit(2), F.length("head") * MAX_EDIT_SHARE))
    # Soft TF-IDF ranks; the whole text's distance only says what is near enough, and parts equal scores.
    best = close.groupBy("framework", "value").agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "edits", "citation_id")).alias("b"))
    return best.select("framework", "value", F.col("b.citation_id").alias("citation_id"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [readings(v, f) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        parts = [pa.array([g[i] for g in got], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *parts], names=["framework", "value", "kind", "literal", "named"])


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """framework, value, citation_id of every distinct pair of ``values`` (framework, value): a ``citation_id`` of the
    framework's entries, or ``unmatched``. Null frameworks have no entries; null values give no row."""
    keys = entries.select("framework", "citation_id").where(F.col("framework").isNotNull() & F.col("citation_id").isNotNull()).distinct()
    pairs = values.where(F.col("value").isNotNull()).select("framework", "value").distinct()
    read = cut_lineage(pairs.mapInArrow(_read, "framework string, value string, kind string, literal string, named string"))
    numbers = read.where(F.col("kind") == "number")
    as_letter = keys.select(F.col("framework").alias("_f"), F.col("citation_id").alias("_c"))
    as_digit = keys.select(F.col("framework").alias("_g"), F.col("citation_id").alias("_d"))
    numbered = (
        numbers.join(as_letter, (F.col("framework") == F.col("_f")) & (F.col("literal") == F.col("_c")), "left")
        .join(as_digit, (F.col("framework") == F.col("_g")) & (F.col("named") == F.col("_d")), "left")
        .select("framework", "value", F.coalesce("_c", "_d", F.lit(UNMATCHED)).alias("citation_id"))
    )
    texts = read.where(F.col("kind") == "text").select("framework", "value", heading_text(F.col("named")).alias("text"))
    ranked = rank_headings(texts.where(F.col("framework").isNotNull() & (F.col("text") != "")), entries)
    r = ranked.select(F.col("framework").alias("_f"), F.col("value").alias("_v"), F.col("citation_id").alias("_c"))
    named = texts.join(r, (F.col("framework") == F.col("_f")) & (F.col("value") == F.col("_v")), "left").select("framework", "value", F.coalesce("_c", F.lit(UNMATCHED)).alias("citation_id"))
    others = read.where(F.col("kind") == "other").select("framework", "value", F.lit(UNMATCHED).alias("citation_id"))
    return numbered.unionByName(named).unionByName(others)


def map_fields(rows: DataFrame, entries: DataFrame, key: str, framework: str, fields: list[str]) -> DataFrame:
    """key, field_name, citation_id of every non-blank value of ``fields`` that isn't an id or display form of an entry
    of the row's framework as it stands. Repeated rows give one row."""
    long = None
    for f in fields:
        part = rows.select(F.col(key), F.lit(f).alias("field_name"), F.col(framework).alias("framework"), F.col(f).alias("value"))
        long = part if long is None else long.unionByName(part)
    long = long.where(F.col("value").rlike(r"[^\s\u00A0\p{IsWhite_Space}]"))
    exact = entries.select(F.col("framework").alias("_f"), F.explode(F.array("citation_id", "display_id")).alias("_v")).distinct()
    open_ = long.join(exact, (F.col("framework") == F.col("_f")) & (F.col("value") == F.col("_v")), "left_anti")
    mapped = map_values(open_, entries).select(F.col("framework").alias("_f"), F.col("value").alias("_v"), "citation_id")
    return open_.join(mapped, F.col("framework").eqNullSafe(F.col("_f")) & (F.col("value") == F.col("_v"))).select(key, "field_name", "citation_id").distinct()
