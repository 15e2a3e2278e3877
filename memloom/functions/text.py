"""Column functions on text. All are built-in expressions; null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicons as lex


def let(value: Column, body) -> Column:
    """Bind an expression once for several uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.transform(raw_tokens(text), F.lower)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({lex.TOKEN_RE})"), F.lit(1))


def sentences(text: Column) -> Column:
    """Stripped parts between ends of sentences, longer than 3 characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(parts, lambda x: F.length(x) > 3)


def sentence_chunks(text: Column, size: int = 2) -> Column:
    """Sentences of 8 characters or more in groups of `size`, joined by a full stop; without any, runs of 24 tokens."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda x: F.btrim(x, F.lit(" \t\r")))
    long = F.filter(parts, lambda x: F.length(x) >= 8)
    group = lambda items, n, glue: let(
        items, lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(n)), lambda i: F.array_join(F.slice(a, i, n), glue))).otherwise(empty())
    )
    return let(long, lambda s: F.when(F.size(s) > 0, group(s, size, ". ")).otherwise(group(tokens(text), 24, " ")))


def normalise(text: Column) -> Column:
    """Lower case, anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def label(text: Column) -> Column:
    """Snake case, `unknown` when nothing is left."""
    snake = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(snake == "", "unknown").otherwise(snake)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\S+)"), F.lit(1))


def entities(text: Column, most: int = 3) -> Column:
    """Three-letter codes of capitalised words that aren't first and aren't stop words, distinct, in order."""
    clean = F.transform(words(text), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    named = F.filter(clean, lambda w, i: (i > 0) & w.rlike("^[A-Z][a-z]+$") & ~F.lower(w).isin(*lex.STOP_WORDS))
    return F.slice(F.array_distinct(F.transform(named, lambda w: F.upper(F.substring(w, 1, 3)))), 1, most)


def topics(text: Column, most: int = 3) -> Column:
    """The heaviest tokens: 1 for each use, 2 more when capitalised, 2 more with an inner capital, _ or -; ties by first use."""
    kept = F.filter(raw_tokens(text), lambda w: ~F.lower(w).isin(*lex.STOP_WORDS) & (F.length(w) >= 3))
    weight = lambda w: F.lit(1) + F.when(w.rlike("^[A-Z]"), 2).otherwise(0) + F.when(w.rlike("^.+[A-Z_-]"), 2).otherwise(0)
    # Sorted by word, equal words are neighbours; one pass sums their weights.
    rows = F.sort_array(F.transform(kept, lambda w, i: F.struct(F.lower(w).alias("w"), i.alias("i"), weight(w).alias("n"))))
    none = F.array().cast("array<struct<n:int,i:int,w:string>>")
    start = F.struct(none.alias("done"), F.lit("").alias("w"), F.lit(0).alias("i"), F.lit(0).alias("n"))
    flush = lambda s: F.when(s["n"] > 0, F.array(F.struct((-s["n"]).alias("n"), s["i"].alias("i"), s["w"].alias("w")))).otherwise(none)
    step = lambda s, x: F.when(s["w"] == x["w"], F.struct(s["done"].alias("done"), s["w"].alias("w"), s["i"].alias("i"), (s["n"] + x["n"]).alias("n"))).otherwise(
        F.struct(F.slice(F.sort_array(F.concat(s["done"], flush(s))), 1, most).alias("done"), x["w"].alias("w"), x["i"].alias("i"), x["n"].alias("n"))
    )
    return F.aggregate(rows, start, step, lambda s: F.transform(F.slice(F.sort_array(F.concat(s["done"], flush(s))), 1, most), lambda x: x["w"]))


def key_sentence(text: Column) -> Column:
    """The sentence with most decision words, short ones preferred; the first of equals, cut to 55 characters."""
    hits = lambda s: sum((F.when(F.contains(F.lower(s), F.lit(w)), 2).otherwise(0) for w in lex.DECISION_WORDS), F.lit(0))
    bonus = lambda s: F.when(F.length(s) < 80, 1).otherwise(0) + F.when(F.length(s) < 40, 1).otherwise(0) - F.when(F.length(s) > 150, 2).otherwise(0)
    scored = F.transform(sentences(text), lambda s, i: F.struct((-(hits(s) + bonus(s))).alias("score"), i.alias("i"), s.alias("s")))
    best = F.coalesce(F.array_min(scored)["s"], F.lit(""))
    return F.when(F.length(best) > 55, F.concat(F.substring(best, 1, 52), F.lit("..."))).otherwise(best)


def lexicon_labels(text: Column, lexicon, most: int = 3) -> Column:
    """Distinct labels whose keyword the lower-cased text contains, in the lexicon's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array(*(F.when(F.contains(low, F.lit(word)), F.lit(name)) for word, name in lexicon))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), 1, most)


def _any(low: Column, these) -> Column:
    found = F.lit(False)
    for word in these:
        found = found | F.contains(low, F.lit(word))
    return found


def scene(text: Column) -> Column:
    """struct(tone, mode, uncertainty) by the first scene words that fit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    mode, tone, doubt = F.lit("discussion"), F.lit("neutral"), F.lit(0.4)
    for these, name in reversed(lex.SCENE_MODES):
        mode = F.when(_any(low, these), name).otherwise(mode)
    for these, name, value in reversed(lex.SCENE_TONES):
        tone = F.when(_any(low, these), name).otherwise(tone)
        doubt = F.when(_any(low, these), value).otherwise(doubt)
    return F.struct(tone.alias("tone"), mode.alias("mode"), doubt.alias("uncertainty"))


def recall_scene(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    made = F.struct(F.lit("neutral").alias("tone"), F.lit("general_recall").alias("mode"), F.lit(0.4).alias("uncertainty"))
    for these, tone, mode, value in reversed(lex.RECALL_SCENES):
        made = F.when(_any(low, these), F.struct(F.lit(tone).alias("tone"), F.lit(mode).alias("mode"), F.lit(value).alias("uncertainty"))).otherwise(made)
    return made


def task_type(question: Column, kind: Column | None = None) -> Column:
    low = F.lower(F.coalesce(question, F.lit("")))
    made = F.lit("event_recall")
    rules = list(lex.TASK_RULES)
    for at in reversed(range(len(rules))):
        made = F.when(_any(low, rules[at][0]), rules[at][1]).otherwise(made)
        if at == 2 and kind is not None:
            made = F.when(F.lower(F.trim(F.coalesce(kind, F.lit("")))) == lex.PREFERENCE_TYPE, "constraint_recall").otherwise(made)
    return made


def weak_cues(question: Column, answer: Column, most: int = 3) -> Column:
    """Topics of both texts, then entities and the head of the answer, distinct."""
    answer = F.coalesce(answer, F.lit(""))
    both = F.concat_ws(" ", F.coalesce(question, F.lit("")), answer)
    cues = F.concat(topics(both), entities(answer), F.array(F.trim(F.substring(answer, 1, 48))))
    return F.slice(F.filter(F.array_distinct(cues), lambda x: x != ""), 1, most)


def evidence_terms(question: Column, cues: Column, names: Column) -> Column:
    """Normalised cues, entities and long question words, distinct, longest first; equal lengths keep their order."""
    long = F.filter(F.split(normalise(question), " "), lambda x: F.length(x) >= 5)
    terms = F.filter(F.transform(F.concat(cues, names, long), normalise), lambda x: F.length(x) >= 3)
    ranked = F.sort_array(F.transform(terms, lambda x, i: F.struct((-F.length(x)).alias("l"), i.alias("i"), x.alias("x"))))
    return F.array_distinct(F.transform(ranked, lambda s: s["x"]))


def compress(text: Column, emotions=lex.EMOTIONS, flags=lex.FLAGS) -> Column:
    """Pipe record: entities, topics, key sentence, emotions, flags; absent parts are left out."""
    join = lambda a, glue, other: F.when(F.size(a) > 0, F.array_join(a, glue)).otherwise(other)
    key = key_sentence(text)
    parts = F.array(
        F.concat(F.lit("0:"), let(entities(text), lambda a: join(a, "+", F.lit("???")))),
        let(topics(text), lambda a: join(a, "_", F.lit("misc"))),
        let(key, lambda k: F.when(k != "", F.concat(F.lit('"'), k, F.lit('"')))),
        let(lexicon_labels(text, emotions), lambda a: join(a, "+", F.lit(None).cast("string"))),
        let(lexicon_labels(text, flags), lambda a: join(a, "+", F.lit(None).cast("string"))),
    )
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "|")


def token_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(F.coalesce(text, F.lit("")))))
