"""Broken prompt and response pairs.

Method: a pushdown parser reads each answer's fences, brackets, quotations, lists and markup; what is still open at the end, the last sentence
included, means truncation. Greedy string tiling covers an answer by stretches of its query. The language is told by the script and by word n-gram
models (n = 1) of the languages, which are fitted on all the pairs themselves: queries are told apart by a few seed words, and the answers that their
query's model explains complete the vocabulary. Refusals are sentences of a grammar per language: who declines, the modal and its negation, and an act
of answering that is declined. Columns are read row by row in Arrow batches; shuffled are the words' counts and what counts a session once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread

DEFECTS = ("empty", "refusal", "copied_query", "other_language", "truncated")  # the first that holds counts
LEAST_SHARE = 1e-6  # a word seen less often than in one of so many pairs weighs next to nothing beside FLOOR and is in no model
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|`[^`]*`")

# fixed values: what stands for no content
PLACEHOLDERS = {"none", "null", "nil", "nan", "n a", "na", "n/a", "undefined", "tbd", "empty", "no answer", "keine", "ninguno", "aucun"}

# fixed values: a few words that questions of one language have and those of the others don't; Hindi is told by its script
SEEDS = {
    "en": "the of and is to for which what how does must".split(), "de": "der die das und ist für welche wie muss wird".split(),
    "fr": "le les des et est pour quel quelle quels dans".split(), "es": "el los las del es para qué cuál cómo debe".split(), "hi": "है का की के क्या".split(),
}
SENTENCE_END = ".!?।॥。！？"
SENTENCES = re.compile(r"(?<=[.!?।])\s+")


def _expand(rule: str, parts: dict[str, str]) -> str:
    """A production with its non-terminals, in angle brackets, replaced by what they stand for; a blank is white space."""
    while "<" in rule:
        rule = re.sub(r"<(\w+)>", lambda m: f"(?:{parts[m[1]]})", rule)
    return rule.replace(" ", r"\s+")


# the grammars of refusals: non-terminals, then the productions of a declining sentence; fixed values
GRAMMARS = {
    "en": ({
        "who": "i|we", "be": "am|are|be|is|was|were",
        "never": "can(?:no|['’])t|can not|could not|couldn['’]t|will not|won['’]t|may not|must not|shall not|would not|wouldn['’]t|do not|don['’]t",
        "unable": "unable to|not (?:able|permitted|allowed|authori[sz]ed|willing|in a position) to",
        "rather": "would (?:rather|prefer) not(?: to)?|prefer not to|wish not to|(?:do not|don['’]t) (?:wish|want|intend) to|(?:must|have to|will)? ?(?:decline|refuse) to",
        "adv": "(?:(?:really|simply|just|further|properly|also|unfortunately|therefore|at present|currently) )?",
        "noun": "answers?|repl(?:y|ies)|responses?|advice|views?|opinions?|comments?|guidance|help|assistance|information|recommendations?",
        "some": "(?:(?:a|an|any|my|our|you|your|further|legal|personal|professional|specific) ){0,3}",
        "request": "(?:this|that|these|those|the|your|such|any)(?: \\w+)? (?:questions?|requests?|quer(?:y|ies)|inquir(?:y|ies)|matters?|topics?|points?)|this|that|it|questions|you",
        "act": "(?:give|offer|provide|share|express|make|take|issue|be of) <some>(?:<noun>)\\b|(?:answer|discuss|handle|fulfil|process) (?:<request>)\\b|advise(?: you)?(?: (?:on|about|in)\\b|\\W*$)"
               "|(?:comment|respond|reply|comply|opine|assist|help)(?: you)?(?: (?:with|on|to|about|in|here|further)\\b|\\W*$)|(?:answer|assist|help|assist with)\\W*$|assist with",
        "rule": "guidelines|instructions|rules|polic(?:y|ies)|terms",
    }, (
        r"\b<who> (?:<never>|(?:<be> )?<unable>|<rather>) <adv>(?:<act>)",
        r"\b(?:i|we)['’](?:m|re) (?:<unable>) <adv>(?:<act>)",
        r"\b<who> (?:must |have to |will )?(?:decline|refuse) (?:<request>)\b",
        r"\b(?:my|our) (?:<rule>) (?:(?:do|does|will) not|don['’]t|doesn['’]t) (?:permit|allow|let)(?: me| us)? (?:to (?:<act>)|<some>(?:<noun>|answering|replying|helping)\b)",
        r"\b(?:my|our) (?:<rule>) (?:forbid|prohibit|prevent|bar)s?(?: me| us)?(?: from)? (?:<some>(?:<noun>)|answering|replying|helping|commenting|(?:giving|offering|providing) <some>(?:<noun>))\b",
        r"\bno (?:<noun>) (?:will|can|may|shall) be (?:given|offered|provided|made)\b",
        r"\b(?:(?:would|is|it['’]s|may) not(?: be)?|isn['’]t|wouldn['’]t be) (?:appropriate|proper|possible|right|permitted|allowed) for (?:me|us) to (?:<act>)",
        r"\bbeyond (?:what <who> (?:may|can|am able to|are able to)(?: do)?|(?:my|our) \w+) to (?:<act>)",
    )),
    "de": ({
        "modal": "kann|darf|möchte|werde|will|könnte|können|dürfen|möchten|werden|wollen", "who": "ich|wir",
        "few": "(?:[^\\s.,;:?!]+ ){0,6}?", "noun": "auskunft|auskünfte|antwort|antworten|rat|beratung|rechtsberatung|empfehlung|meinung|einschätzung|stellungnahme|hilfe|ansicht",
        "give": "geben|erteilen|abgeben|anbieten|leisten|äußern", "act": "beantworten|antworten|helfen|weiterhelfen|beraten|kommentieren|stellung nehmen|auskunft geben|behilflich sein|bearbeiten",
        "back": "(?:<act>)|(?:zu )?(?:<noun>) zu (?:<give>)|zu (?:<act>)",
    }, (
        r"\b(?:(?:<modal>) (?:<who>)|(?:<who>) (?:<modal>)) <few>(?:nicht <few>(?:<act>)|keine[nrs]? (?:\w+ )?(?:<noun>) (?:<give>))\b",
        r"\b(?:ich|wir) (?:bin|sind) <few>(?:nicht (?:in der lage|befugt|berechtigt)|außerstande),? <few>(?:<back>)\b",
        r"\bes ist (?:mir|uns) <few>nicht (?:möglich|erlaubt|gestattet),? <few>(?:<back>)\b",
        r"\b(?:eine|keine) (?:<noun>) (?:wird|kann|darf) <few>(?:erteilt|gegeben)\b",
        r"\b(?:meine|unsere) (?:richtlinien|vorgaben|regeln) (?:erlauben|gestatten) <few>(?:nicht|keine)\b",
        r"\b(?:muss|müssen) (?:ich|wir) <few>(?:ablehnen|verweigern)\b",
    )),
    "fr": ({
        "give": "donner|fournir|formuler|émettre|offrir|apporter|exprimer", "noun": "avis|réponses?|conseils?|aide|opinion|informations?|recommandations?",
        "some": "(?:d['’]|de |un |une |des |aucun |aucune |mon |cette )?(?:\\w+ )?",
        "act": "répondre|aider|assister|conseiller|commenter|me prononcer|traiter (?:cette|votre) (?:demande|question)|(?:<give>) <some>(?:<noun>)",
        "to": "(?:vous |y |lui )?",
    }, (
        r"\b(?:je|nous) (?:ne |n['’])(?:peux|puis|saurais|souhaite|veux|pouvons|saurions|souhaitons) (?:(?:pas|point) )?<to>(?:<act>)\b",
        r"\b(?:je|nous) ne (?:suis|sommes) pas (?:en mesure|autorisée?s?|habilitée?s?) (?:de|à|d['’]) ?<to>(?:<act>)\b",
        r"\bil ne (?:m['’]|nous )est pas (?:permis|possible) (?:de |d['’])<to>(?:<act>)\b",
        r"\b(?:je|nous) (?:dois|devons|préfère|préférons) (?:refuser|décliner|ne pas <to>(?:<act>))\b",
        r"\b(?:mes|nos) (?:règles|consignes|directives) (?:ne (?:me |nous )?permettent pas|(?:m['’]|nous )?interdisent)\b",
    )),
    "es": ({
        "give": "dar|ofrecer|proporcionar|emitir|brindar|expresar", "noun": "respuesta|asesoramiento|asesoría|opinión|consejo|consejos|ayuda|información|recomendación",
        "act": "ayudar(?:le|te|les)?|responder(?:le)?|contestar|asesorar|opinar|asistir|atender|comentar|(?:<give>) (?:un |una |mi |ninguna? )?(?:\\w+ )?(?:<noun>)",
    }, (
        r"\bno (?:puedo|podemos|debo|debemos|quiero|deseo) (?:<act>)\b", r"\bno (?:me|nos) (?:está|es|resulta) (?:permitido|posible) (?:<act>)\b",
        r"\b(?:debo|debemos|tengo que|prefiero) (?:rechazar|declinar|no (?:<act>))\b", r"\b(?:mis|nuestras) (?:normas|directrices|instrucciones) (?:no (?:me |nos )?permiten|(?:me |nos )?(?:prohíben|impiden))\b",
    )),
    "hi": ({
        "noun": "उत्तर|जवाब|सलाह|मदद|सहायता|राय|टिप्पणी|जानकारी", "few": "(?:[^\\s।?!]+ ){0,8}?",
    }, (
        r"(?:मैं|हम) <few>(?:<noun>) (?:नहीं (?:दे|कर|बता) (?:सकता|सकती|सकते)|(?:देने|करने) में असमर्थ)", r"(?:<noun>) (?:देना|करना) (?:मेरे|हमारे) लिए (?:संभव|सम्भव|उचित) नहीं",
        r"(?:मुझे|हमें) <few>(?:<noun>) (?:देने|करने) की (?:अनुमति|इजाज़त|इजाजत) नहीं", r"(?:मेरे|हमारे) (?:दिशानिर्देश|नियम) <few>नहीं",
    )),
}
REFUSAL = re.compile("|".join(_expand(rule, parts) for parts, rules in GRAMMARS.values() for rule in rules), re.IGNORECASE)
# every production has one of these words of the first person or of the declined act; fixed values
FIRST = re.compile(
    r"\b(?:i|we|me|us|my|our|no|ich|wir|mir|uns|meine|unsere|eine|keine|je|nous|m|mes|nos|puedo|podemos|debo|debemos|quiero|deseo|nos|tengo|prefiero|mis|nuestras)\b|मैं|हम|मेरे|मुझे", re.IGNORECASE)
DENIAL = re.compile(
    r"n['’]t\b|\b(?:not|cannot|no|unable|declin|refus|prefer|forbid|prohibit|prevent|bar|beyond|nicht|kein|außerstande|ablehn|verweiger|ne|n|dois|devons|rechazar|declinar|prohíben|impiden)|नहीं|असमर्थ", re.IGNORECASE)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    words = WORD.findall(text.lower())
    return not words or " ".join(words) in PLACEHOLDERS


def is_refusal(text: str) -> bool:
    """A sentence in which the writer declines; quotations are left out."""
    if not FIRST.search(text) or not DENIAL.search(text):
        return False
    return any(REFUSAL.search(s) for s in SENTENCES.split(QUOTED.sub(" ", text)) if FIRST.search(s) and DENIAL.search(s))


def tiled(pattern: list[str], text: list[str], least: int = 3) -> int:
    """Greedy string tiling: how many words of ``text`` longest-first tiles from ``pattern`` cover. A stretch of the pattern may be used
    again, so that an answer that says the query twice is covered as well."""
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(pattern) - least + 1):
        places.setdefault(tuple(pattern[i:i + least]), []).append(i)
    matches = []
    for j in range(len(text) - least + 1):
        for i in places.get(tuple(text[j:j + least]), ()):
            if i and j and pattern[i - 1] == text[j - 1]:
                continue  # inside a longer one
            n = least
            while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n]:
                n += 1
            matches.append((n, j))
    taken = [False] * len(text)
    for n, j in sorted(matches, reverse=True):
        # what longer tiles left of this one is tiled where it is long enough without a gap
        k = j
        while k < j + n:
            end = k
            while end < j + n and not taken[end]:
                end += 1
            if end - k >= least:
                taken[k:end] = [True] * (end - k)
            k = end + 1
    return sum(taken)


def is_copy(query: list[str], text: list[str]) -> bool:
    """The words of the text have nothing but those of the query, up to two words or a tenth."""
    if not query or not text:
        return False
    if len(query) < 3 or len(text) < 3:
        return query == text
    allowed = max(2, len(text) // 10)
    known = set(query)
    if sum(w not in known for w in text) > allowed:
        return False
    rest = len(text) - tiled(query, text)
    return rest <= allowed and len(text) - rest >= 0.6 * len(query)


def plain_words(text: str) -> list[str]:
    """Words that tell a language: those in small letters, or of a script without them, outside quotations."""
    return [w for w in WORD.findall(QUOTED.sub(" ", text)) if w[0].isalpha() and not w[0].isupper()]


class Languages:
    """Word models of the languages. ``logs`` has the log probability of each word in every language, ``known`` the words that are each language's own."""

    def __init__(self, counts: dict[str, Counter]):
        self.names = sorted(counts)
        total = {k: max(1, sum(c.values())) for k, c in counts.items()}
        words = {w for c in counts.values() for w in c}
        # the same floor for all, so that a word that none has says nothing, however much text a language has
        self.logs = {w: tuple(math.log(counts[k][w] / total[k] + FLOOR) for k in self.names) for w in words}
        # a word is a language's own if it isn't ten times as frequent in another
        most = {w: max(counts[k][w] / total[k] for k in self.names) for w in words}
        self.known = {k: {w for w, n in c.items() if n >= 2 and 10 * n >= most[w] * total[k]} for k, c in counts.items()}
        self.trigrams = {k: {t for w in known for t in trigrams(w)} for k, known in self.known.items()}

    def fits(self, lang: str, words: list[str]) -> float:
        """Share of the words that are the language's own, or are made of its words' trigrams for the most part."""
        known, own = self.known[lang], self.trigrams[lang]
        n = 0
        for w in words:
            n += w in known or sum(t in own for t in trigrams(w)) >= 0.75 * len(w)
        return n / len(words)

    def scores(self, words: Iterable[str]) -> list[float]:
        rows = [self.logs[w] for w in set(words) if w in self.logs]
        return list(map(sum, zip(*rows))) if rows else [0.0] * len(self.names)

    def best(self, words: list[str]) -> str | None:
        """The likeliest language; None if no word is known or two are as likely."""
        scores = self.scores(words)
        order = sorted(scores)
        return self.names[scores.index(order[-1])] if order[-1] < 0 and order[-1] - order[-2] > 1 else None

    def differs(self, ours: str | None, words: list[str]) -> bool:
        """The words are likelier in another language, by MARGIN; or of at least five few fit ours, as in a language that no query has."""
        if not ours or len(words) < 2:
            return False
        scores = self.scores(words)
        if max(scores) - scores[self.names.index(ours)] > MARGIN:
            return True
        return len(words) >= 5 and self.fits(ours, words) < UNLIKE


FLOOR = 1e-4
STRANGE = "?"
MARGIN = 7.0  # natural logarithm of how much likelier another language must be
UNLIKE = 0.4


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i:i + 3] for i in range(len(word))]


Row = tuple[list[str], list[list[str]]]
Count = Callable[..., dict[str, Counter]]


def _words(pairs: Iterable[tuple[str | None, ...]]) -> Iterator[Row]:
    """(words of the query, words of each answer that isn't a refusal)"""
    for q, *texts in pairs:
        if q:
            yield plain_words(q.lower()), [plain_words(t) for t in texts if t and not is_refusal(t)]


def _query_words(rows: Iterable[Row], models: Languages) -> dict[str, Counter]:
    counts: dict[str, Counter] = {}
    for query, _texts in rows:
        lang = models.best(query)
        if lang:
            counts.setdefault(lang, Counter()).update(query)
    return counts


def _answer_words(rows: Iterable[Row], queries: Languages, models: Languages, least: float) -> dict[str, Counter]:
    counts: dict[str, Counter] = {}
    for query, texts in rows:
        lang = queries.best(query)
        for words in texts if lang else ():
            if words and sum(w in models.known[lang] for w in words) >= least * len(words) and models.best(words) == lang:
                counts.setdefault(lang, Counter()).update(words)
    return counts


def _strange_words(rows: Iterable[Row], queries: Languages, models: Languages) -> dict[str, Counter]:
    strange: Counter = Counter()
    for query, texts in rows:
        lang = queries.best(query)
        for words in texts if lang else ():
            if len(words) >= 5 and sum(w in models.known[lang] for w in words) < 0.4 * len(words) and models.best(words) in (lang, None):
                strange.update(set(words).difference(*(models.known[k] for k in SEEDS)))
    return {STRANGE: strange} if strange else {}


def _fit(count: Count) -> Languages:
    """Models from the words that ``count(step, *arguments)`` counts over all pairs. Queries are told by the seed words, again by the models of those, and
    then answers that their query's language explains better than any other, more than half of whose words the queries or other such answers
    have, are added. Answers few of whose words any language has give the model of the languages that no query is written in."""

    def added(to: dict[str, Counter], more: dict[str, Counter]) -> dict[str, Counter]:
        return {k: c + more.get(k, Counter()) for k, c in to.items()}

    models = Languages({k: Counter(dict.fromkeys(v, 20)) for k, v in SEEDS.items()})
    counts = seeds = {k: Counter(dict.fromkeys(v, 1)) for k, v in SEEDS.items()}
    for _ in range(2):
        counts = added(seeds, count(_query_words, models))
        models = Languages(counts)
    queries, more = models, counts
    for least in (0.3, 0.5, 0.5):
        more = added(counts, count(_answer_words, queries, models, least))
        models = Languages(more)
    # what no query is written in, but answers are: a language of its own
    strange = count(_strange_words, queries, models)
    return Languages(more | strange) if strange else models


def fit_languages(pairs: Iterable[tuple[str | None, str | None, str | None]]) -> Languages:
    """Models from (query, answer, reasoning)."""
    rows = list(_words(pairs))
    return _fit(lambda step, *given: step(rows, *given))


def fit_table(pairs: DataFrame) -> Languages:
    """The models of fit_languages from all rows of a table (query, short_answer, reasoning). Their words are written once and read for each step; what
    comes to the driver are the counts of the words that ``LEAST_SHARE`` of the pairs have."""
    context = pairs.sparkSession.sparkContext

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _words(zip(batch["query"], batch["short_answer"], batch["reasoning"]))
            yield pd.DataFrame([(" ".join(q), [" ".join(t) for t in texts]) for q, texts in found], columns=["query", "texts"])

    rows = cut(spread(pairs.select("query", "short_answer", "reasoning")).mapInPandas(read, "query string, texts array<string>"))
    floor = LEAST_SHARE * rows.count()

    def count(step: Callable, *given) -> dict[str, Counter]:
        shared = context.broadcast(given)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = batch["texts"] if "texts" in batch else [()] * len(batch)
                found = step(((q.split(), [t.split() for t in ts]) for q, ts in zip(batch["query"], texts)), *shared.value)
                yield pd.DataFrame([(k, w, n) for k, c in found.items() for w, n in c.items()], columns=["lang", "word", "n"])

        read_from = rows.select("query") if step is _query_words else rows
        counts = read_from.mapInPandas(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= floor)
        out: dict[str, Counter] = {}
        for r in counts.collect():
            out.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
        shared.unpersist()
        return out

    return _fit(count)


MARKS = re.compile(r"```|`|\*\*|[\"„()\[\]{}«»“”]|<(?P<close>/?)(?P<tag>[a-z][a-z0-9]*)(?:\s[^<>]*)?>", re.IGNORECASE)
ALONE = {"br", "hr", "img", "input"}
PARTNER = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
INTERVAL = re.compile(r"\s*[-−]?[\w.∞]+\s*[,;]\s*[-−+]?[\w.∞]+\s*")
ITEM = re.compile(r"\s*(?:[-*•]|\(?(?:\d{1,3}|[a-z])[.)])\s+\S")
# fixed values: a statement that names a code is finished with it: noun, verb, code
DESIGNATION = re.compile(r"\b(?:heading|position|partida|शीर्षक)\s+(?:is|ist|lautet|est|es|है)\s+\d{4}(?:\.\d{2}){0,2}$", re.IGNORECASE)


def open_at_end(text: str) -> list[str]:
    """Pushdown parser: the marks that are still open when the text ends. Inside code nothing but its end counts. A closer takes with it what was opened
    behind its partner; without a partner it is passed over, as after a list's number. A half-open interval closes with either bracket."""
    stack: list[tuple[str, int]] = []

    def close(mark: str) -> bool:
        if all(s != mark for s, _ in stack):
            return False
        while stack.pop()[0] != mark:
            pass
        return True

    for m in MARKS.finditer(text):
        c, i = m.group(), m.start()
        top = stack[-1][0] if stack else ""
        if top in ("```", "`") and c != top:
            continue
        if m["tag"]:
            name = "<" + m["tag"].lower()
            if name[1:] not in ALONE and not (m["close"] and close(name)) and not m["close"]:
                stack.append((name, i))
        elif c in ("```", "`", "**", '"'):
            if c == '"' and i and text[i - 1].isdigit() and all(s != c for s, _ in stack):
                continue  # inches
            if not close(c):
                stack.append((c, m.end()))
        elif c == "„":
            stack.append(("“", m.end()))
        elif c in "([{«" or c == "“" and top != "“":
            stack.append((c, m.end()))
        elif c == "“":
            stack.pop()  # „…“ closes with the character that opens “…”
        elif c in ")]" and top in ("(", "[") and PARTNER[c] != top and INTERVAL.fullmatch(text, stack[-1][1], i):
            stack.pop()
        else:
            close(PARTNER[c])
    return [s for s, _ in stack]


def open_sentence(text: str) -> bool:
    """Whether the last sentence goes on: behind its last word neither a full stop, nor the end of a bracket, quotation or markup, nor a finished
    designation; an item of a list whose other items have no full stops is complete."""
    bare = text.rstrip("\"'”»)]}’*_`")
    if not bare:
        return False
    if bare.endswith(("...", "…")):
        return True
    if bare[-1] in SENTENCE_END or bare != text and text[-1] in ")]}»”`" or bare[-1] == ">" and MARKS.fullmatch(bare[bare.rfind("<"):]):
        return False
    lines = text.split("\n")
    if len(lines) > 1 and ITEM.match(lines[-1]) and any(ITEM.match(x) and x.rstrip()[-1] not in SENTENCE_END for x in lines[:-1]):
        return False
    return not DESIGNATION.search(bare)


def is_truncated(text: str) -> bool:
    text = text.rstrip()
    return bool(open_at_end(text)) or open_sentence(text)


def defect(query: str | None, answer: str | None, reasoning: str | None, languages: Languages) -> str | None:
    """The first defect in the order of DEFECTS that one of the two texts has. A null or blank query is no basis for a copy or a language."""
    if is_empty(answer) or is_empty(reasoning):
        return "empty"
    both = (answer, reasoning)
    if any(map(is_refusal, both)):
        return "refusal"
    if query and query.strip():
        q = WORD.findall(query.lower())
        if any(is_copy(q, WORD.findall(t.lower())) for t in both):
            return "copied_query"
        ours = languages.best(plain_words(query.lower()))
        if any(languages.differs(ours, plain_words(t)) for t in both):
            return "other_language"
    return "truncated" if any(map(is_truncated, both)) else None


def find_defects(pairs: DataFrame, id_col: str = "session_id") -> DataFrame:
    """(session_id, defect): defective sessions. Rows without an id are left out; a session delivered twice counts once, with the first defect in the
    order of DEFECTS. The language models are fitted on all pairs that are judged."""
    named = pairs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "query", "short_answer", "reasoning")
    languages = pairs.sparkSession.sparkContext.broadcast(fit_table(named))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = languages.value
        for batch in batches:
            found = [(i, DEFECTS.index(d)) for i, q, a, r in zip(batch["id"], batch["query"], batch["short_answer"], batch["reasoning"])
                     if (d := defect(q, a, r, models))]
            yield pd.DataFrame(found, columns=["id", "rank"])

    names = F.array(*map(F.lit, DEFECTS))
    return (spread(named).mapInPandas(run, "id string, rank int").groupBy("id").agg(F.min("rank").alias("rank"))
            .select(F.col("id").alias(id_col), F.element_at(names, F.col("rank") + 1).alias("defect")))
