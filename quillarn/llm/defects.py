"""Problem 6: defective answers.

Predictions are read in the one form of problem 5, beside the question and the aliases of their ``stable_id``. The first
that fits of

* ``empty``: null, or no letter or digit to see;
* ``refusal``: a phrase that declines or says it cannot answer, with no name or number in it that would be an answer;
* ``copy``: the words of the question or of its beginning, perhaps again and again, and nothing else;
* ``language``: a phrase whose language, by the posterior of a naive Bayes model over character n-grams of its words, is
  another than the question's; words in capitals are names and have no language, nor has a phrase all in small letters
  unless at least half of its words are known in its language and ``KNOWN`` of these not in the question's;
* ``truncated``: the end of the text is unlikely. A model of n-grams at the ends of complete answers (all aliases) gives
  the probability that a text ends after its last characters; a phrase ends with a full stop; a beginning of an alias that
  stops inside a word is cut.

A prediction that reads like an alias has no defect. The language model is fitted on at most ``SAMPLE`` labelled documents,
the least by hash; the end-of-text model counts all aliases into a table of fixed size. Defined results: a prediction whose
``stable_id`` has no reference is judged without question and aliases; repeated rows are judged each; ``output_ids`` may be
null, as truncation shows in the text alone.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillarn.llm import lookalike
from quillarn.operators.skew import salted_join

SAMPLE, SAMPLE_CHARS = 6000, 5000
#: Least lead of the best language's logarithmic posterior over the question's language.
LEAD = 4.0
#: So many words that the question's language doesn't know show that a phrase in small letters is none of names.
KNOWN = 2
#: A text that ends with less probability than this is cut.
END = 0.03
SLOTS = 1 << 20
#: The first slots count words of so many letters.
LONGEST = 64

# Phrases that decline.
REFUSALS = regex.compile(
    r"\b(?:(?:can ?not|can't|can not|could not|couldn't|won't|will not|unable to|not able to|be able to|not possible (?:for me )?to|decline to|declining to|refuse to|refusing to|must decline)"
    r" ?(?:\w+ )?(?:answer|help|respond|reply|say|tell|assist|provide|discuss|be answered)"
    r"|(?:don't|do not|doesn't|does not) (?:have (?:enough |any |that |this |the )?(?:information|knowledge|context|data)|know(?: the answer| that| this|[.!]?$)|contain)"
    r"|no (?:knowledge|information|comment|idea|answer can)\b|not contain|cannot be (?:answered|determined)|can't be (?:answered|determined)"
    r"|(?:i'd|would|i would) rather not|prefer not to|my apologies|i apologi[sz]e|i'm sorry|i am sorry|outside what i can|as an (?:ai|assistant)|not sure"
    r"|kann ich (?:leider )?nicht|nicht beantworten|weiß (?:ich|es) (?:leider )?nicht|keine (?:informationen|angaben|antwort)|tut mir leid"
    r"|ne (?:peux|puis|sais|dispose) pas|désolé|aucune (?:information|idée|réponse)|pas (?:en mesure de )?répondre"
    r"|no (?:puedo|sé|dispongo|tengo)\b|lo siento|no es posible responder|não (?:posso|sei|disponho|tenho)|desculpe|lamento"
    r"|nie (?:mogę|wiem|mam|potrafię)|przykro mi|не (?:могу|знаю)|извините|к сожалению|答えられません|わかりません|分かりません|申し訳)",
    regex.I,
)
#: What makes a phrase with such words an answer after all.
ANSWERS = regex.compile(r"\bdiffer, but\b|\bmost (?:give|say)\b|\bthat it was\b|\bsources? say\b|\bbut (?:it was|most)\b|\bthe usual answer\b|\bthe answer is\b|\bbook is called\b|^it (?:was|must be)\b", regex.I)
# Small words of names and titles, and small words that end no text.
PARTICLES = set("a an the of at to from in on by and de la le les du des el los las del y von der die das dem den und im am d l o a os as do da dos das e w z i na ad".split())
OPEN = set("""a an the of at to from in on by and or but with that which who whose where when while because although as than then into onto near beside behind
under over between for its his her their was were is are be been being had has have not le les du des et ou qui que dont avec pour par chez sur dans une un aux
von dem den des und oder der die das mit für bei nach über zum zur ein eine einer el los las del y que con para por una en do da dos das e com um uma na no w z na do od oraz który""".split())
VERBS = set("was were is are be says say said wrote opened lived recorded".split())
# Common words that every language's model knows, whatever the documents say.
COMMON = {
    "en": "the of and to in is was were are it that this which who whose what when where how many did does do by for on at from with as not most more people there usually said have been has had be year",
    "fr": "le la les un une des du de et est sont était a ont été qui que quoi quel quelle quels quelles où quand comment combien pourquoi elle il ils c'est qu'il s'agit dans par pour sur avec sans doute selon après avant année ville on pense ce cette ne pas plus fut",
    "de": "der die das ein eine einer und ist war sind wurde wurden hat haben wird wer was wann wo wie wem welche welcher welchem welches warum in im am an auf von vom zu zum mit nach bei aus für nicht man hier meistens sagt nennt es sich jahr stadt wohl so",
    "es": "el la los las un una unos de del y es son era fue fueron qué quién cuál cuándo dónde cómo cuánto cuántos se en por para con sin sobre según que como no más año ciudad su lo al hay está cree dicen este esta",
    "pt": "o a os as um uma de do da dos das e é são era foi foram que quem qual quando onde como quanto se em no na por para com sem sobre segundo não mais ano cidade seu sua ao há está isso este esta",
    "pl": "i w we na z ze do od po o u jest są był była było były kto co kiedy gdzie jak który która które ile dlaczego się nie to ten ta tym że przez dla roku miasto według więcej niż został została",
    "it": "il lo la gli le un uno una di del della e è sono era fu chi che cosa quale quando dove come quanto perché si in per con senza su secondo non più anno città suo al è questo questa",
}
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
#: Names and numbers alone: nothing but words in capitals and particles, without a full stop.
NAMES = regex.compile(r"[\p{Lu}\d][\p{L}\p{M}\d'’,-]*+(?: (?:of|de|von|the|at|to|from|[\p{Lu}\d][\p{L}\p{M}\d'’,-]*+))*+")
ALIEN = regex.compile(r"[^\p{Latin}\p{Common}\p{Inherited}]")
STOPS = tuple(".!?。！？…)]\"”’'»）")
FOREIGN = {s: regex.compile(rf"\p{{{s}}}") for s in ("Cyrillic", "Han", "Hiragana", "Katakana", "Hangul", "Greek", "Arabic", "Hebrew", "Thai", "Devanagari")}
LIKE_LATIN = set("".join(lookalike.LOOKS.values()))


def _words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]


class Languages:
    """Naive Bayes over character n-grams of words written small."""

    def __init__(self, samples: list[tuple[str, str]]):
        words = [(lang, Counter(w for w in WORD.findall(text) if w.islower())) for lang, text in samples]
        self.fit(words)
        # labels are wrong now and then: fit again with the language each text is in by the first fit
        self.fit([(max(p, key=p.get), c) for _, c in words if c for p in [self.posterior(list(c))]])

    def fit(self, words: list[tuple[str, Counter]]) -> None:
        by: dict[str, Counter] = {}
        for lang, c in words:
            by.setdefault(lang, Counter()).update(c)
        for lang in by:
            n = max(1, sum(by[lang].values()) // 500)
            by[lang].update({w: n for w in COMMON.get(lang, "").split()})
        # a word that a language has more often than others do: foreign words and wrong labels are rare
        top = Counter()
        for c in by.values():
            for w, n in c.items():
                top[w] = max(top[w], n)
        self.known = {lang: {w for w, n in c.items() if n > 1 and 2 * n >= top[w]} for lang, c in by.items()}
        self.grams: dict[str, Counter] = {}
        for lang, c in by.items():
            grams = self.grams[lang] = Counter()
            for w, n in c.items():
                for g in _grams(w):
                    grams[g] += n
        self.total = {k: sum(c.values()) for k, c in self.grams.items()}
        self.kinds = len(set().union(*self.grams.values())) if self.grams else 1
        self.memo: dict[str, dict[str, float]] = {}

    def word(self, w: str) -> dict[str, float]:
        if w not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            g = _grams(w)
            # a word counts as much as its length, not as its overlapping grams
            self.memo[w] = {k: sum(math.log((c[x] + 0.3) / (self.total[k] + 0.3 * self.kinds)) for x in g) / 3 for k, c in self.grams.items()}
        return self.memo[w]

    def posterior(self, words: list[str]) -> dict[str, float]:
        return {k: sum(self.word(w)[k] for w in words) for k in self.grams}


class Ends:
    """How likely a text ends after its last two to four characters."""

    def __init__(self, seen: np.ndarray, ended: np.ndarray):
        self.seen, self.ended = seen, ended
        self.base = (ended.sum() / 3 + 1) / (seen.sum() / 3 + 10)

    def probability(self, text: str) -> float:
        c = np.frombuffer(("  " + text.casefold())[-4:].encode("utf-32-le"), np.uint32).astype(np.uint64)
        p = self.base
        for n in (2, 3, 4):
            s = int(_context(c, n)[-1])
            p = (self.ended[s] + 2 * p) / (self.seen[s] + 2)
        return float(p)

    def word(self, letters: int) -> float:
        """How likely a last word that has so many letters ends there."""
        k = min(letters, LONGEST - 1)
        return float((self.ended[k] + 1) / (self.seen[k] + 2))


def _context(c: np.ndarray, n: int) -> np.ndarray:
    """Slots of the last ``n`` characters at each position from the n-th on."""
    h = np.full(len(c) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h % np.uint64(SLOTS - LONGEST)).astype(np.int64) + LONGEST


def fit_ends(refs: DataFrame, column: str) -> Ends:
    """Count the ends of all texts of an array column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ended = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for b in batches:
            text = "".join(f"  {x.casefold()}\n" for x in b.column(0).flatten().to_pylist() if x)
            c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            if len(c) < 5:
                continue
            for n in (2, 3, 4):
                s = _context(c[:-1], n)
                inside = np.ones(len(s), bool)
                for k in range(n):
                    inside &= c[k : k + len(s)] != 10
                over = inside & (c[n:] == 10)
                seen += np.bincount(s[inside], minlength=SLOTS)
                ended += np.bincount(s[over], minlength=SLOTS)
            at = np.arange(len(c))
            space = np.maximum.accumulate(np.where((c == 32) | (c == 10), at, 0))
            s = (at - space)[:-1]
            inside = (s > 0) & (s < LONGEST)
            seen += np.bincount(s[inside], minlength=SLOTS)
            ended += np.bincount(s[inside & (c[1:] == 10)], minlength=SLOTS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at]), pa.array(ended[at])], ["slot", "seen", "ended"])

    rows = refs.select(column).mapInArrow(count, "slot bigint, seen bigint, ended bigint").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended")).toArrow()
    seen, ended = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    seen[rows.column("slot").to_numpy()] = rows.column("seen").to_numpy()
    ended[rows.column("slot").to_numpy()] = rows.column("ended").to_numpy()
    return Ends(seen, ended)


def fit_languages(documents: DataFrame) -> Languages:
    """Fit the language model on labelled documents."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    rows = documents.where(F.col("lang").rlike(r"^\s*[A-Za-z]{2}\s*$") & F.length("text").between(100, SAMPLE_CHARS)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select(lang.alias("lang"), "text").collect()
    common = {k for k, n in Counter(r.lang for r in rows).items() if n >= max(5, 0.005 * len(rows))}
    return Languages([(r.lang, r.text) for r in rows if r.lang in common])


class Judge:
    def __init__(self, languages: Languages, ends: Ends):
        self.languages, self.ends = languages, ends
        self.memo: dict[str, list[str]] = {}

    def asked(self, question: str) -> list[str]:
        """The words of a question; those of the last ones are remembered."""
        if question not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[question] = _words(question)
        return self.memo[question]

    def judge(self, form: str | None, question: str | None, forms: list[str]) -> str | None:
        """The defect of a prediction in its one form, or None."""
        if form is None or not WORD.search(form):
            return "empty"
        if form in forms:
            return None
        q = self.asked(question or "")
        if NAMES.fullmatch(form) and form.split(" ", 1)[0].casefold() not in (*q[:1], "question", "q") and not REFUSALS.search(form) and not ALIEN.search(form):
            # no refusal, not the question's first word, Latin names alone: no copy and no language
            return "truncated" if form[-1] in "-," or (form[-1].isalpha() and self.cut(form, forms)) else None
        if self.refuses(form, forms):
            return "refusal"
        p = _words(form)
        rest = self.after_copy(q, p)
        if rest is None:
            return "copy"
        if rest < len(p):  # the question, then an answer
            last = list(WORD.finditer(form))[rest]
            form = form[last.start() :] if rest else form
            if form in forms:
                return None
        if rest == 0 and self.foreign(form, question or "", forms):
            return "language"
        return "truncated" if self.cut(form, forms) else None

    @staticmethod
    def refuses(form: str, forms: list[str]) -> bool:
        first = regex.split(r"(?<=[.!?。])\s", form, maxsplit=1)
        if len(first) > 1 and len(WORD.findall(first[0])) > 1 and Judge.refuses(first[0], forms):
            return True
        m = REFUSALS.search(form)
        if not m or ANSWERS.search(form) or regex.search(r"\d", form):
            return False
        words = WORD.findall(form)
        # titles: nearly all words but particles begin with capitals, or what comes last names a place
        big = [w for w in words if w.casefold() not in PARTICLES]
        if len(big) > 2 and sum(w[0].isupper() for w in big) >= 0.8 * len(big) and not form.isupper():
            return False
        names = [w for w in words[1:] if w[0].isupper() and w not in {"I", "I'd", "I'm", "I’m", "I’d", "AI"} and not form.isupper() and not regex.match(r"Informationen|Angaben|Antwort|Frage|Leid", w)]
        return not names and not regex.search(r"\b(?:at|from|to|of) \S+$", form.casefold().rstrip(".")) or bool(regex.search(r"(?:answer|information|say|that|this|request|topic|question|sorry|discuss|help)[.!]?$", form.casefold()))

    @staticmethod
    def after_copy(q: list[str], p: list[str]) -> int | None:
        """Where in the words ``p`` the copied question ends: 0 if it isn't copied, None if there is nothing else."""
        at = 1 if p[:1] in (["question"], ["q"]) else 0
        if not q or len(p) - at < min(3, len(q)):
            return 0
        rounds = 0
        while at < len(p):
            n = 0
            while at + n < len(p) and n < len(q) and p[at + n] == q[n]:
                n += 1
            if at + n == len(p) or (at + n == len(p) - 1 and n < len(q) and n >= 2 and q[n].startswith(p[-1])):
                return None if rounds or n >= min(3, len(q)) or at + n == len(p) - 1 else 0
            if n < len(q):
                return at if rounds else 0
            at, rounds = at + n, rounds + 1
            if p[at : at + 1] in (["question"], ["q"]):
                at += 1
        return None

    def foreign(self, form: str, question: str, forms: list[str]) -> bool:
        for pattern in FOREIGN.values() if ALIEN.search(form) else ():
            mine = [c for c in pattern.findall(form) if c not in LIKE_LATIN]
            letters = len(regex.findall(r"\p{L}", question)) or 1
            if len(mine) >= 3 and len(pattern.findall(question)) < 0.3 * letters and len(mine) >= 0.1 * len(regex.findall(r"\p{L}", form)):
                return True
        words = WORD.findall(form)
        small = [w for w in words if w.islower() and not w[0].isdigit()]
        if not any(w not in PARTICLES for w in small):
            return False
        bare = form.islower() and not form.endswith(".") and not regex.search(r"\d", form)
        if bare and any(f.casefold().startswith(form.casefold()) for f in forms):
            return False
        if len(words) > 1 and words[0][0].isupper() and (words[1].islower() or len(words[0]) <= 3):
            small.append(words[0].lower())
        if len(small) < 2:
            return False
        asked = WORD.findall(question)
        told = [w.lower() for i, w in enumerate(asked) if w.islower() or i == 0 or not any(x.islower() for x in asked)]
        if len(told) < 2 or question.istitle() or question == question.upper():
            told = [w.lower() for w in asked]
        mine, theirs = self.languages.posterior(small), self.languages.posterior(told)
        if not mine:
            return False
        best, top = max(mine, key=mine.get), max(theirs.values())
        near = [k for k, v in theirs.items() if v > top - LEAD]
        if mine[best] - max(mine[k] for k in near) <= LEAD:
            return False
        if not bare:
            return True
        # names in small letters have a language by chance only
        known = [w for w in small if w in self.languages.known[best]]
        own = {w for w in known if not any(w in self.languages.known[k] for k in near)}
        return 2 * len(known) >= len(small) and len(own) >= KNOWN and not own <= PARTICLES

    def cut(self, form: str, forms: list[str]) -> bool:
        if form.endswith(STOPS):
            return False
        if form[-1] in ",;:-–—([{“«„":
            return True
        words = WORD.findall(form)
        last = words[-1].casefold()
        low = form.casefold()
        if last in OPEN and len(words) > 1:
            return True
        if any(f.casefold().startswith(low) and f[len(form) : len(form) + 1].isalpha() and form[-1].isalpha() for f in forms):
            return True
        small = [w for w in words[1:] if w.islower() and not w[0].isdigit() and w not in PARTICLES]
        if not form.islower() and (len(small) > 1 or any(w in VERBS for w in small)):
            return True
        return form[-1].isalpha() and self.ends.probability(form) < END and self.ends.word(len(form) - form.rfind(" ") - 1) < END


def defects(predictions: DataFrame, references: list[DataFrame], documents: DataFrame) -> DataFrame:
    """(ordinal, defect) of each defective prediction."""
    refs = references[0].select("stable_id", "question", "aliases")
    for r in references[1:]:
        refs = refs.union(r.select("stable_id", "question", "aliases"))
    table = lookalike.learn([(predictions, "prediction"), (refs, "aliases")])
    refs = lookalike.rewritten(refs, "aliases", table, "forms")
    preds = lookalike.rewritten(predictions.select("ordinal", "stable_id", "prediction"), "prediction", table, "form")
    judge = predictions.sparkSession.sparkContext.broadcast(Judge(fit_languages(documents), fit_ends(refs, "forms")))
    known = refs.groupBy("stable_id").agg(F.min("question").alias("question"), F.flatten(F.collect_list(F.coalesce("forms", F.array().cast("array<string>")))).alias("forms"))
    both = salted_join(preds.select("ordinal", "stable_id", "form"), known, ["stable_id"], F.col("ordinal"), predictions.select("stable_id"), "left")
    odd = both.where(F.col("form").isNull() | ~F.coalesce(F.array_contains("forms", F.col("form")), F.lit(False))).select("ordinal", "form", "question", "forms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = judge.value
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            for i, form, question, forms in zip(ids, *(b.column(k).to_pylist() for k in (1, 2, 3))):
                d = j.judge(form, question, forms or [])
                if d:
                    found.append((i, d))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["ordinal", "defect"])

    return odd.mapInArrow(run, "ordinal bigint, defect string")
