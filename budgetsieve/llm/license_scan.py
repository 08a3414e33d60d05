"""License scans by a positional index of rare words, in DataFrame functions alone.

A template is a license notice as words, with one or two key phrases of it that are mandatory. The words
of all key phrases are counted over all documents; the index keeps, for each template, the places of its
``RARE`` words of highest inverse document frequency. A file's words are looked up there: each occurrence
of an indexed word gives the places where the template would start, and these postings are intersected,
so that places on which two of the rare words agree are left. There every key phrase has to stand word
for word, at most ``slack`` words from its relative place. Names of licenses ("mit license") are templates
as well, all of whose words are the key phrase, with no slack. All three rare words stand in any file
that holds the key phrases, and two of them in one of these, so that the index loses no file.

Text and null handling: A-Z are lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole
text, null is empty. Rows are scanned one by one without a shuffle, so that repeated rows, null ids, very
long texts and frequent phrases cost no more than their own words; ties between words go to the word that
sorts first. The only table that is gathered has one row a word of the key phrases. Extra columns stay;
empty tables give empty ones, and the index of one is in the order of the words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 3
#: Words by which a key phrase may be off its relative place, as names and years are put in.
SLACK = 16
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """label, notice and key phrases (one or two, each of two different words at least); base: a name to be counted."""

    label: str
    notice: str
    phrases: tuple[str, ...]
    slack: int = SLACK
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    def places(self) -> list[tuple[int, list[str]]]:
        """Each key phrase with its place in the notice."""
        out = []
        for phrase in self.phrases:
            words = phrase.split()
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(words)] == words)
            out.append((at, words))
        return out


def name(label: str, words: str) -> Template:
    return Template(label, words, (words,), slack=0, base=True)


#: Names that are counted, and public license notices. Fixed values.
TEMPLATES = (
    name("mit", "mit license"),
    name("apache", "apache license"),
    name("gpl", "general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it under the terms of the", "published by the free software foundation")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("terms of the mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. The two signs whose small letters are ASCII go another way."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    small = F.when(text.contains("K") | text.contains("İ"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(small, BETWEEN), "")


def key_words(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for _, phrase in t.places() for w in phrase})


def document_frequency(docs: DataFrame, words: Sequence[str], text: str = "text") -> DataFrame:
    """Number of documents that hold each of the words, for those that any holds."""
    held = F.array_distinct(F.filter(words_of(F.col(text)), lambda w: w.isin(*words)))
    return docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs"))


def rare_words(templates: Sequence[Template], frequency: dict[str, int]) -> list[list[str]]:
    """Of each template's key phrases the words in the fewest documents; ties: the word that sorts first."""
    return [sorted({w for _, p in t.places() for w in p}, key=lambda w: (frequency.get(w, 0), w))[:RARE] for t in templates]


def _literal(words: Sequence[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _starts(words: Column, hits: Column, template: Template, rare: Sequence[str]) -> Column:
    """Places where the template stands: rare words agree on them, and every key phrase is near its place."""

    def postings(word: str) -> Column:
        at = F.array(*[F.lit(i) for i, w in enumerate(template.words) if w == word])
        return F.flatten(F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: F.transform(at, lambda p: h["at"] - p)))

    lists = [postings(w) for w in rare]
    pairs = [F.array_intersect(a, b) for i, a in enumerate(lists) for b in lists[i + 1 :]]
    agreed = F.array_sort(F.array_distinct(F.concat(*pairs)))

    def near(start: Column, at: int, phrase: list[str]) -> Column:
        first, last = start + (at - template.slack), start + (at + template.slack)
        here = F.sequence(F.greatest(first, F.lit(0)), last)
        return F.when(last < 0, F.lit(False)).otherwise(F.exists(here, lambda x: F.slice(words, x + 1, len(phrase)) == _literal(phrase)))

    return F.filter(agreed, lambda start: reduce(lambda a, b: a & b, [near(start, at, phrase) for at, phrase in template.places()]))


def _share(words: Column, starts: Column, template: Template) -> Column:
    """The largest share of the template's words that stand in their relative place."""
    notice = _literal(template.words)
    at_start = F.transform(starts, lambda s: F.size(F.filter(notice, lambda w, i: F.coalesce(F.get(words, s + i) == w, F.lit(False)))))
    return F.array_max(at_start) / F.lit(float(len(template.words)))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


FOUND = "array<struct<label:string,base:boolean,starts:array<int>,share:double>>"


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", frequency: dict[str, int] | None = None) -> DataFrame:
    """Adds n_words and licenses: the templates found, with the places where they start and their best share.

    ``frequency`` is the number of documents a key word; by default it is counted over ``docs``.
    """
    if frequency is None:
        frequency = {r["word"]: r["n_docs"] for r in document_frequency(docs, key_words(templates), text).collect()}
    rare = rare_words(templates, frequency)
    first, indexed = sorted({r[0] for r in rare}), sorted({w for r in rare for w in r})

    def found(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(*indexed))

        def one(hits: Column, template: Template, rare: Sequence[str]) -> Column:
            def told(starts: Column) -> Column:
                return F.struct(F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), starts.alias("starts"), _share(words, starts, template).alias("share"))

            return _let(_starts(words, hits, template, rare), told)

        def all_of(hits: Column) -> Column:
            return F.filter(F.array(*[one(hits, t, r) for t, r in zip(templates, rare)]), lambda x: F.size(x["starts"]) > 0)

        licenses = F.when(F.exists(words, lambda w: w.isin(*first)), _let(hits, all_of).cast(FOUND)).otherwise(F.array().cast(FOUND))
        return F.struct(F.size(words).cast("long").alias("n_words"), licenses.alias("licenses"))

    return docs.withColumn("__scan", _let(words_of(F.col(text)), found)).withColumns({"n_words": F.col("__scan.n_words"), "licenses": F.col("__scan.licenses")}).drop("__scan")


def labels_of(licenses: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(licenses, lambda x: x["label"]))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, its words, the places of license names, labels by name and by notice, and the best share."""
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("licenses", lambda x: x["base"])
    starts = F.flatten(F.transform(base, lambda x: x["starts"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels_of(base).alias("base_labels"),
        labels_of(F.col("licenses")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    def row(*values: object) -> str:
        return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"

    notices = ", ".join(row(k, t.label, t.base, t.slack, len(t.words)) for k, t in enumerate(TEMPLATES))
    words = ", ".join(row(k, i, w) for k, t in enumerate(TEMPLATES) for i, w in enumerate(t.words))
    phrases = ", ".join(row(k, at, p) for k, t in enumerate(TEMPLATES) for at, p in t.places())
    return f"""
WITH notices(t, label, base, slack, size) AS (VALUES {notices}), places(t, p, w) AS (VALUES {words}), phrases(t, p, ws) AS (VALUES {phrases}),
cut AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM cut),
keys AS (SELECT DISTINCT t, unnest(ws) AS w FROM phrases),
counted AS (SELECT w, count(DISTINCT k) AS n FROM words SEMI JOIN keys USING (w) GROUP BY w),
rare AS (SELECT t, w FROM (SELECT t, keys.w, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), keys.w) AS nth FROM keys LEFT JOIN counted USING (w)) WHERE nth <= {RARE}),
agreed AS (SELECT k, t, i - p AS o FROM words JOIN rare USING (w) JOIN places USING (t, w) GROUP BY k, t, o HAVING count(DISTINCT words.w) >= 2),
standing AS (SELECT a.k, a.t, a.o FROM agreed a JOIN notices n USING (t) JOIN phrases f USING (t) JOIN cut c USING (k)
    WHERE len(list_filter(range(greatest(a.o + f.p - n.slack, 0), a.o + f.p + n.slack + 1), lambda x: c.ws[x + 1 : x + len(f.ws)] = f.ws)) > 0
    GROUP BY a.k, a.t, a.o HAVING count(*) = (SELECT count(*) FROM phrases q WHERE q.t = a.t)),
shares AS (SELECT s.k, s.t, s.o, count(w.i) AS same FROM standing s JOIN places p USING (t) LEFT JOIN words w ON w.k = s.k AND w.i = s.o + p.p AND w.w = p.w GROUP BY s.k, s.t, s.o),
told AS (SELECT k, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(same / size::DOUBLE) AS score FROM shares JOIN notices USING (t) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM cut LEFT JOIN told USING (k)
"""


#: The same result in SQL.
SQL = _sql()
