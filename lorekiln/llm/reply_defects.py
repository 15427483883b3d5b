"""Broken prompt and response pairs: which replies are no usable reply, and why.

Five tests run on every field in a fixed order, the first that holds names the defect: ``empty``, ``copied_question``,
``refusal``, ``other_language``, ``truncated``. The language test compares the posteriors of prompt and reply from a
character n-gram naive Bayes model; the refusal test weighs a sentence's words and word pairs, those of given refusals
against those of all texts at hand; the truncation test weighs how likely a text ends after its last words, by an
interpolated n-gram model of text ends over all replies. No model is cut to a number of entries that depends on the
data: what reaches the driver is bounded by shares of the counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekiln.functions.text import missing_py
from lorekiln.plans.stage import Stages

LANGUAGES = ("en", "de", "fr", "es", "it")
TRAIN_PER_LANGUAGE = 400  # labelled texts a language for the naive Bayes model
PROMPT_GRAMS = 1_000_000  # n-grams that all prompts together weigh at most in the naive Bayes model
RARE = 1e-6  # share of a language's n-grams below which one is left out: at most a million a language are kept
FREQUENT = 25_000  # a word that is at least one in so many keeps a class of its own: at most as many as this
MARGIN = 1.5  # nats by which another language must win
LEAST_WORDS = 3
CLIP = 2.0  # nats one word may add to a language's lead
END_BELOW = 0.05  # probability of an end under which a text counts as broken off
ORDER = 4  # words in the longest context of a text end, the two marks before a text included
REFUSED = 5.0  # nats by which a sentence must be nearer to refusals than to other texts
SALTS = 16  # parts of the rows that end alike
_FLUSH = 300_000  # counts that a task holds

#: Short prose that seeds each language, also where no labelled text exists.
SEED_TEXT = {
    "en": "The old man who lived in the house by the sea had never told anyone what he saw that night, but when the winter came and "
    "there was nothing left to eat, his daughter asked him why they could not go with the others. He said that it was too far and that "
    "the roads were closed. Where would you go? Who would take you? How many days, and for which reason? Then she opened the door, took "
    "her coat and left without another word. She had been in the town before, because her mother was born there, and some of them still "
    "knew her. At last everything was quiet again under the bridge, behind the church and in the long street near the market.",
    "de": "Der alte Mann, der in dem Haus am Meer lebte, hatte niemandem erzählt, was er in jener Nacht gesehen hat, aber als der Winter kam "
    "und nichts mehr zu essen da war, fragte ihn seine Tochter, warum sie nicht mit den anderen gehen konnten. Er sagte, dass es zu weit "
    "sei und die Straßen gesperrt wären. Wohin würdest du gehen? Wer hat dich gesehen? Wann und wie viele Tage? Dann öffnete sie die Tür, "
    "nahm ihren Mantel und ging ohne ein weiteres Wort. Sie war schon früher in der Stadt gewesen, weil ihre Mutter dort geboren wurde, und "
    "einige kannten sie noch. Endlich war alles wieder still unter der Brücke, hinter der Kirche und in der langen Straße neben dem Markt.",
    "fr": "Le vieil homme qui vivait dans la maison au bord de la mer n'avait jamais dit à personne ce qu'il avait vu cette nuit-là, mais quand "
    "l'hiver est venu et qu'il ne restait plus rien à manger, sa fille lui a demandé pourquoi ils ne pouvaient pas partir avec les autres. Il "
    "a répondu que c'était trop loin et que les routes étaient fermées. Où irais-tu ? Qui t'a vue ? Quand, et combien de jours ? Alors elle a "
    "ouvert la porte, a pris son manteau et elle est partie sans un mot de plus. Elle était déjà venue en ville, parce que sa mère y était née, "
    "et quelques-uns la connaissaient encore. Enfin tout était calme sous le pont, derrière l'église et dans la longue rue à côté du marché.",
    "es": "El viejo que vivía en la casa junto al mar nunca había dicho a nadie lo que vio aquella noche, pero cuando llegó el invierno y ya no "
    "quedaba nada para comer, su hija le preguntó por qué no podían irse con los otros. Él respondió que estaba demasiado lejos y que los "
    "caminos estaban cerrados. ¿Adónde irías? ¿Quién te ha visto? ¿Cuándo y cuántos días? Entonces ella abrió la puerta, tomó su abrigo y se "
    "fue sin decir otra palabra. Ya había estado en la ciudad, porque su madre nació allí, y algunos todavía la conocían. Por fin todo estaba "
    "tranquilo debajo del puente, detrás de la iglesia y en la larga calle al lado del mercado, aunque nadie lo sabía.",
    "it": "Il vecchio che viveva nella casa vicino al mare non aveva mai detto a nessuno quello che aveva visto quella notte, ma quando arrivò "
    "l'inverno e non restava più niente da mangiare, sua figlia gli chiese perché non potevano andare via con gli altri. Lui rispose che era "
    "troppo lontano e che le strade erano chiuse. Dove andresti? Chi ti ha visto? Quando e quanti giorni? Allora lei ha aperto la porta, ha "
    "preso il suo cappotto ed è uscita senza dire un'altra parola. Era già stata in città, perché sua madre era nata lì, e alcuni la "
    "conoscevano ancora. Finalmente tutto era tranquillo sotto il ponte, dietro la chiesa e nella lunga via accanto al mercato, anche se non lo sapeva.",
}


_ALNUM = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\"[^\"]*\"")


def plain(text: str) -> str:
    if text.isascii():
        return " ".join(text.split())
    t = unicodedata.normalize("NFKC", text)
    return " ".join(t.replace("’", "'").replace("“", '"').replace("”", '"').split())


# ---------------------------------------------------------------- language


def words_in(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def char_grams(words: dict[str, int]) -> Counter:
    """Character 2- to 4-grams of counted words, a word's ends marked by a space."""
    out: Counter = Counter()
    for word, times in words.items():
        w = f" {word} "
        for n in (2, 3, 4):
            for i in range(len(w) - n + 1):
                out[w[i : i + n]] += times
    return out


class LanguageModel:
    """Naive Bayes over character n-grams with add-half smoothing; words are the units of evidence."""

    def __init__(self, counts: dict[str, Counter]):
        self.counts, self.langs = counts, sorted(counts)
        grams = sorted(set().union(*counts.values()))
        total = np.array([sum(counts[k].values()) + 0.5 * (len(grams) + 1) for k in self.langs])
        table = np.array([[counts[k][g] for k in self.langs] for g in grams] + [[0] * len(self.langs)], float)
        self.table = np.log((table + 0.5) / total)
        self.index = {g: i for i, g in enumerate(grams)}
        self.known: dict[str, int] = {}
        self.seen = np.zeros((1024, len(self.langs)))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "counts": {}, "seen": self.seen[:1024]}

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word (rows) by language. The orders overlap, so their sum is averaged; and no word may
        speak louder than ``CLIP`` nats, as names follow no language. Words are remembered."""
        if len(self.known) > 200_000:
            self.known.clear()
        known = self.known
        at = []
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
                if i >= len(self.seen):
                    self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
                get, last = self.index.get, len(self.index)
                v = self.table[[get(g, last) for g in char_grams({w: 1}).elements()]].sum(axis=0) / 3
                self.seen[i] = np.maximum(v - v.max(), -CLIP)
            at.append(i)
        return self.seen[at] if at else np.zeros((0, len(self.langs)))

    def score(self, text: str) -> np.ndarray:
        """Log posterior by language up to a constant."""
        return self.words(_LETTERS.findall(text.lower())).sum(axis=0)


def gram_counts(texts: DataFrame, label) -> dict[str, dict[str, float]]:
    """{language: {n-gram: count}} of (k, t); ``label`` gives a text's language or None. Counted on the workers, whole
    texts; n-grams of a share below ``RARE`` of their language stay there."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}

        def out() -> pd.DataFrame:
            rows = [(k, g, n) for k, w in words.items() for g, n in char_grams(w).items()]
            words.clear()
            return pd.DataFrame(rows, columns=["k", "g", "n"])

        for b in batches:
            for k, t in zip(b["k"], b["t"]):
                t = plain(t)
                of = label(k, t)
                if of is not None:
                    words.setdefault(of, Counter()).update(words_in(t))
            if sum(map(len, words.values())) > _FLUSH:
                yield out()
        if words:
            yield out()

    n = texts.select("k", "t").mapInPandas(count, "k string, g string, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    n = Stages(texts.sparkSession, "grams").put(n)
    least = n.groupBy("k").agg((F.sum("n") * RARE).alias("least"))  # one row a language
    counts: dict[str, dict[str, float]] = {}
    for r in n.join(F.broadcast(least), "k").where("n >= least").select("k", "g", "n").toLocalIterator():
        counts.setdefault(r.k, {})[r.g] = r.n
    return counts


def fit_languages(
    documents: DataFrame, pairs: DataFrame | None = None, text: str = "text", lang: str = "lang", question: str = "question"
) -> LanguageModel:
    """Fit on seeds and at most ``TRAIN_PER_LANGUAGE`` labelled texts a language, the ones of smallest hash; then once
    more with all distinct prompts of ``pairs`` that the first model assigns without doubt, so that a language without
    labelled texts is learnt in the wording of the pairs. The prompts together weigh no more than ``PROMPT_GRAMS``."""
    counts = {k: char_grams(Counter(words_in(SEED_TEXT[k]))) for k in LANGUAGES}
    usable = documents.where(F.lower(lang).isin(*LANGUAGES) & (F.length(text) > 40))
    usable = usable.select(F.lower(lang).alias("k"), F.col(text).alias("t"))
    bucket = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("t"), "t"))
    usable = usable.withColumn("lot", bucket).where(F.col("lot") <= TRAIN_PER_LANGUAGE)
    for k, grams in gram_counts(usable, lambda k, t: k).items():
        counts[k].update(grams)
    model = LanguageModel(counts)
    if pairs is not None:
        asked = pairs.where(F.length(question) > 20).select(F.lit(None).cast("string").alias("k"), F.col(question).alias("t")).distinct()

        def sure(_: str | None, t: str) -> str | None:
            s = model.score(t)
            first, second = np.sort(s)[::-1][:2]
            return model.langs[int(s.argmax())] if first - second > 4 * MARGIN else None

        more = gram_counts(asked, sure)
        total = sum(sum(g.values()) for g in more.values())
        scale = min(1.0, PROMPT_GRAMS / total) if total else 1.0
        for k, grams in more.items():
            counts[k].update({g: n * scale for g, n in grams.items()})
        model = LanguageModel(counts)
    return model


def other_language(model: LanguageModel, question: str, reply: str, margin: float = MARGIN) -> bool:
    """True if a language other than the question's beats it by ``margin`` in the reply, on the evidence of at least
    ``LEAST_WORDS`` words. Names and numbers stay undecided; words in quotes and words of the question do not count."""
    return speaks_otherwise(model, Prompt(model, question), reply, margin)


def speaks_otherwise(model: LanguageModel, prompt: Prompt, reply: str, margin: float = MARGIN) -> bool:
    """``other_language`` for a prompt already looked at."""
    gap, words = language_gap(model, prompt, reply)
    return gap > margin and words >= LEAST_WORDS


class Prompt:
    """What the tests of all replies need of one prompt."""

    def __init__(self, model: LanguageModel, question: str):
        letters = _LETTERS.findall(question.lower())
        self.letters = set(letters)
        self.language = int(model.words(letters).sum(axis=0).argmax())
        self.tokens = _tokens(question)
        self.bag = set(self.tokens)


def language_gap(model: LanguageModel, prompt: Prompt, reply: str) -> tuple[float, int]:
    """Lead of the reply's best language over the prompt's, and how many words speak for it."""
    if '"' in reply:
        reply = _QUOTED.sub(" ", reply)
    own = prompt.letters
    each = model.words([w for w in _LETTERS.findall(reply.lower()) if w not in own])
    if not len(each):
        return 0.0, 0
    r = each.sum(axis=0)
    ask, best = prompt.language, int(r.argmax())
    return float(r[best] - r[ask]), int((each[:, best] - each[:, ask] > 0.5).sum())


# ---------------------------------------------------------------- refusals

#: Sentences that decline to reply, which the refusal model is fitted on.
REFUSALS = (
    "I cannot answer this question.", "I'm sorry, but I can't help with that.", "I am unable to provide an answer.",
    "I am not able to respond to this request.", "I won't discuss this topic.", "I will not answer that.",
    "I would rather not say.", "I must decline to answer.", "I have to decline this request.",
    "I refuse to answer this question.", "I do not have enough information to respond.", "I have no answer to give.",
    "There is nothing I can offer on that topic.", "We are not able to answer this.", "We decline to give an answer.",
    "We cannot provide the requested text.", "As an AI, I cannot assist with this request.",
    "As an AI language model, I am not allowed to discuss this.", "This model is not permitted to answer this question.",
    "The assistant is unable to complete this request.", "This assistant declines to continue.",
    "My guidelines do not allow me to answer.", "My instructions prevent me from replying.",
    "My programming keeps me from discussing it.", "The content policy blocks this reply.",
    "Answering would violate my policies.", "This goes against my guidelines.",
    "That request falls outside what I am allowed to do.", "No answer can be given to this prompt.",
    "No response can be generated for this request.", "It would not be appropriate for me to respond.",
    "I am not comfortable answering that.", "I don't feel able to discuss this.", "I have been told not to talk about this.",
    "I was instructed not to discuss it.", "Let us talk about something else instead.", "Please ask me something else.",
    "Please try rephrasing your question.", "Is there anything else I can help you with?",
    "I apologize, but I can't comply with this request.", "Unfortunately, I can't share that information.",
    "Regrettably, I am not in a position to help.", "Please consult another source, as I cannot reply.",
    "I do not wish to continue this conversation.", "I am not going to write that.",
    "I have no access to the source, so I can't say.", "I'm afraid I can't do that.",
    "Thank you for asking, but I cannot comment on it.", "I don't know how to answer that without more context.",
    "I can't speculate about the story.", "I may not produce the text you asked for.", "The assistant may not share a reply.", "Ich kann diese Frage nicht beantworten.",
    "Es tut mir leid, aber dabei kann ich nicht helfen.", "Leider kann ich dazu keine Auskunft geben.",
    "Leider darf ich darauf nicht antworten.", "Als KI kann ich dazu nichts sagen.", "Ich möchte mich dazu nicht äußern.",
    "Meine Richtlinien erlauben mir keine Antwort.", "Ich muss diese Anfrage ablehnen.",
    "Je ne peux pas répondre à cette question.", "Je suis désolé, mais je ne peux pas vous aider.",
    "Je regrette, je ne suis pas en mesure de répondre.", "En tant qu'IA, je ne peux pas en parler.",
    "Mes consignes ne me permettent pas de répondre.", "Je dois refuser cette demande.", "No puedo responder a esta pregunta.",
    "Lo siento, pero no puedo ayudar con eso.", "Lamentablemente no puedo dar esa información.",
    "Como IA, no puedo hablar de este tema.", "Mis normas no me permiten contestar.", "Debo rechazar esta solicitud.",
    "Non posso rispondere a questa domanda.", "Mi dispiace, ma non posso aiutare con questo.",
    "Purtroppo non posso fornire queste informazioni.", "Come IA, non posso parlarne.",
    "Le mie linee guida non mi permettono di rispondere.", "Devo rifiutare questa richiesta.",
)
#: Sentences with words that refusals have too, which decline nothing; with ``SEED_TEXT`` the general half of what the
#: refusal model holds refusals against.
NARRATED = (
    "She could not answer him and left.", "He would not say what he had seen.", "As she later told us, they had no time to help.",
    "They were not allowed to leave the house.", "The rules of the guild did not permit it.", "No answer came from the tower.",
    "There was nothing else to do, as the others had gone.", "I was told that the king refused the request.", "We had to decline the offer of the old man.",
    "My father had no access to the room.", "It was not possible to provide food for the whole town.", "Please give me the book, she said.",
    "He was unable to speak and asked for more water.", "The question of the queen was about this story.", "As a way to thank them, I gave my coat.",
    "This was the reason for the journey, but it was not the only one.", "She is sorry for what she did to us.", "The answer is in the text of the letter.",
    "I do not know who it was, but he was with me on that day.", "We cannot see the sea from here.", "Because of this they did not talk to us any more.",
    "It would have been better to try another way.", "That is what I can remember of it.", "The assistant of the doctor may have seen it.",
)
_SAID = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PART = re.compile(r"(?<=[.!?;])\s+")


def spoken(text: str) -> list[list[str]]:
    """The words of each sentence in the text's own voice: what others say in quotes is left out."""
    t = _QUOTED.sub(" ", text) if '"' in text else text
    return [_SAID.findall(p) for p in _PART.split(t.lower())]


def pairs_of(words: list[str]) -> list[str]:
    """Neighbouring words, the beginning of a sentence included."""
    return [f"{a} {b}" for a, b in zip(["^", *words], words)]


def counted_words(texts) -> tuple[Counter, int]:
    """Words and pairs of texts, and how many words."""
    n: Counter = Counter()
    size = 0
    for t in texts:
        for words in spoken(plain(t)):
            n.update(words)
            n.update(pairs_of(words))
            size += len(words)
    return n, size


class RefusalModel:
    """Log odds of the words and word pairs of refusals against those of other texts; a word that no refusal has speaks
    against one."""

    def __init__(self, others: dict[str, int], total: int):
        """``others``: counts of the known words and pairs in the texts at hand; ``total``: all words counted there. The
        general half of the background does not depend on them."""
        own, size = counted_words(REFUSALS)
        general, base = counted_words([*SEED_TEXT.values(), *NARRATED])
        rest = 0.5 if total else 0.0

        def weight(g: str, n: int) -> float:
            usual = (1 - rest) * (general[g] + 0.02 * base / size) / base
            usual += rest * (others.get(g, 0) + 0.02 * total / size) / max(total, 1)
            return max(-2.5, min(2.5, float(np.log((n + 0.02) / size / usual))))

        self.weights = {g: weight(g, n) for g, n in own.items()}

    def score(self, text: str) -> float:
        """Of the sentence nearest to a refusal."""
        get = self.weights.get
        return max(sum([get(w, -1.0) for w in words]) + sum([get(g, 0.0) for g in pairs_of(words)]) for words in spoken(text))


def fit_refusals(texts: DataFrame, text: str = "text") -> RefusalModel:
    """The words and pairs of ``REFUSALS``, counted over all ``texts`` (replies and prompts; refusals among them are too
    few to matter); nothing else comes to the driver."""
    known = set(RefusalModel({}, 0).weights)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t in b["t"].dropna():
                for words in spoken(plain(t)):
                    n[""] += len(words)
                    n.update([w for w in words if w in known])
                    n.update([g for g in pairs_of(words) if g in known])
        if n:
            yield pd.DataFrame({"g": list(n), "n": list(n.values())})

    rows = texts.select(F.col(text).alias("t")).mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    others = {r.g: r.n for r in rows.collect()}  # as many as refusals have
    return RefusalModel(others, others.get("", 0))


def refuses(model: RefusalModel, reply: str) -> bool:
    """The reply's own voice declines to reply."""
    return model.score(reply) > REFUSED


# ---------------------------------------------------------------- copies

_LEAD = re.compile(r"^\s*(?:(?:[^\W\d_]+[ ,]+){0,4}[^\W\d_]+\s*[:–-]|(?:sure|ok|okay|well|hmm|yes)\s*[.!,]+)\s*", re.I)


def _tokens(text: str) -> list[str]:
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return _ALNUM.findall(text.casefold())


def copies(question: str | Prompt, reply: str) -> bool:
    """The reply gives the question back, once or more, and nothing else: up to a lead-in with a colon, few words may
    be lost, added or mistyped (one in five)."""
    q = _tokens(question) if isinstance(question, str) else question.tokens
    bag = set(q) if isinstance(question, str) else question.bag
    n = len(q)
    if n < 3:
        return False
    for body in {reply, _LEAD.sub("", reply)}:
        r = _tokens(body)
        times = max(1, round(len(r) / n))
        if not 0.8 * n * times <= len(r) <= 1.25 * n * times or sum(w in bag for w in r) < 0.5 * len(r):
            continue
        own = sum((Counter(r) & Counter({w: k * times for w, k in Counter(q).items()})).values())
        if own >= 0.8 * len(r) and own >= 0.8 * n * times:
            return True
        if SequenceMatcher(None, " ".join(r), " ".join(q * times), autojunk=False).ratio() > 0.9:
            return True
    return False


# ---------------------------------------------------------------- ends of texts

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[^\w\s]|_")
_CLOSERS = "\"'”’»)]}"
_STOP = ".!?…。！？"
_CLOSING = {".": 1.0, "!": 1.0, "?": 1.0, ";": 1.0, ",": 0.5}


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


def unclosed(text: str) -> bool:
    """A bracket opens and does not close."""
    return any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}"))


def closed(text: str) -> bool:
    """The text ends by closing all its brackets or quotes, so nothing was cut off."""
    return (text.endswith(")") and not unclosed(text)) or (text.endswith('"') and text.count('"') % 2 == 0)


def stripped(text: str) -> tuple[str, bool]:
    """The text without trailing stops and closing marks; whether a proper full stop was among them."""
    t = text.rstrip()
    end = len(t)
    while end and (t[end - 1] in _STOP or t[end - 1] in _CLOSERS or t[end - 1].isspace()):
        end -= 1
    tail = t[end:]
    dots = tail.count(".")
    proper = bool(re.search(r"[.!?。！？]", tail)) and dots < 2 and "…" not in tail
    return t[:end], proper


class Words:
    """Words that a field's texts use often: ``words`` keep a class of their own, all ``common`` ones are no halves."""

    def __init__(self, words: set[str], common: set[str]):
        self.words, self.common = words, common
        self.prefixes = {w[:i] for w in words for i in range(2, len(w))}

    def fragment(self, token: str) -> bool:
        """Not a known word, but the beginning of one."""
        t = token.lower()
        return t not in self.common and t in self.prefixes

    def end_key(self, field: str, tokens: list[str]) -> str:
        """Field, place and last ``ORDER`` classes of a text's end: all that ``EndModel`` looks at."""
        k = ["<s>", "<s>", *(word_class(self.words, t) for t in tokens[-ORDER:])]
        return "\x1f".join([field, str(min(len(tokens), 5)), *k[-min(ORDER, len(tokens) + 2) :]])


class EndModel:
    """P(text or sentence ends | last words) of a field, interpolated from the last word over its place in the text to
    the last ``ORDER`` word classes. The words are held here, the contexts stay a table (c, seen, ended)."""

    def __init__(self, words: Words, contexts: DataFrame):
        self.words, self.contexts = words, contexts

    def p_end(self, ends: DataFrame) -> DataFrame:
        """(end, p) for a column ``end`` of distinct keys of ``Words.end_key``."""

        def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(e, i, c) for e in b["end"] for i, c in enumerate(contexts_of(e))]
                if rows:
                    yield pd.DataFrame(rows, columns=["end", "i", "c"])

        asked = ends.select("end").mapInPandas(expand, "end string, i int, c string")
        known = asked.join(self.contexts, "c", "left")
        each = F.sort_array(F.collect_list(F.struct("i", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("ended", F.lit(0.0)).alias("ended"))))
        p = F.aggregate("x", F.lit(0.1), lambda p, x: (x["ended"] + 4 * p) / (x["seen"] + 4))
        return known.groupBy("end").agg(each.alias("x")).select("end", p.alias("p"))  # ORDER + 1 contexts an end


def contexts_of(end: str) -> list[str]:
    """The contexts of a key of ``Words.end_key``, as ``contexts_at`` gives them."""
    field, place, *k = end.split("\x1f")
    out = [f"{field}\x1f{k[-1]}", f"{field}\x1f#{place}\x1f{k[-1]}"]
    out.extend(field + "\x1f" + "\x1f".join(k[-m:]) for m in range(2, len(k) + 1))
    return out


def contexts_at(field: str, k: list[str], i: int) -> list[str]:
    """Contexts of the position ``i`` of a padded text, from the widest class to the narrowest."""
    out = [f"{field}\x1f{k[i]}", f"{field}\x1f#{min(i - 1, 5)}\x1f{k[i]}"]
    out.extend(field + "\x1f" + "\x1f".join(k[i - m + 1 : i + 1]) for m in range(2, min(ORDER, i + 1) + 1))
    return out


def word_class(words: set[str], token: str) -> str:
    """A frequent word, a mark, or the class of numbers, names and rare words."""
    if token.isdigit():
        return "<n>"
    if not token[0].isalpha():
        return token
    t = token.lower()
    return t if t in words else "<x>"


def fit_ends(replies: DataFrame, field: str = "field", text: str = "text") -> EndModel:
    """Counted over all rows of ``replies`` (field, text). Words that are frequent (one in ``FREQUENT``) and mostly
    written small keep their own class. An end is a sentence end inside a text or the end of a text; a closing clause
    counts too, a comma by half. In a field where most texts close with a full stop, ends without one are no evidence;
    elsewhere they are, unless a bracket is open or dots trail off."""
    spark = replies.sparkSession
    work = Stages(spark, "ends")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        small: Counter = Counter()
        big: Counter = Counter()

        def out() -> pd.DataFrame:
            keys = list(small.keys() | big.keys())
            got = pd.DataFrame({"w": keys, "small": [small[k] for k in keys], "big": [big[k] for k in keys]})
            small.clear(), big.clear()
            return got

        for b in batches:
            for t in b["t"].dropna():
                for i, w in enumerate(tokens_of(plain(t))):
                    if w[0].isalpha():
                        (big if w[0].isupper() and i else small)[w.lower()] += 1
            if len(small) + len(big) > _FLUSH:
                yield out()
        if small or big:
            yield out()

    rows = replies.select(F.col(field).alias("f"), F.col(text).alias("t"))
    full = F.col("t").rlike(r"[^.][.!?][\s\"'”’)\]]*$")
    shares = rows.where("t is not null").groupBy("f").agg(F.count("*").alias("n"), F.avg(full.cast("double")).alias("share")).collect()
    stopped = {r.f for r in shares if r.share > 0.5}  # one row a field
    w = rows.mapInPandas(words, "w string, small long, big long").groupBy("w").agg(F.sum("small").alias("s"), F.sum("big").alias("b"))
    w = work.put(w, "words")
    least = max(4, (w.agg(F.sum(F.col("s") + F.col("b"))).first()[0] or 0) // FREQUENT)
    kept = w.where(F.col("s") + F.col("b") >= least).collect()
    work.drop(w)
    common = {r.w for r in kept}
    known = {r.w for r in kept if r.s >= least and r.s > 1.5 * r.b}
    sent = spark.sparkContext.broadcast((known, stopped))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, stopped = sent.value
        seen: Counter = Counter()
        ended: Counter = Counter()

        def out() -> pd.DataFrame:
            keys = list(seen)
            got = pd.DataFrame({"c": keys, "seen": list(seen.values()), "ended": [float(ended[x]) for x in keys]})
            seen.clear(), ended.clear()
            return got

        for b in batches:
            for f, t in zip(b["f"], b["t"]):
                if t is None or missing_py(t):
                    continue
                t = plain(t)
                body, proper = stripped(t)
                k = ["<s>", "<s>", *(word_class(known, x) for x in tokens_of(body))]
                trusted = proper or closed(t) or (f not in stopped and not unclosed(t) and not t.endswith(("…", "...")))
                for i in range(2, len(k)):
                    if k[i] in ".!?":
                        continue
                    last = i == len(k) - 1
                    if last and not trusted:
                        continue
                    # a clause that closes here might have been the last one
                    end = 1.0 if last else _CLOSING.get(k[i + 1], 0.0)
                    for c in contexts_at(f, k, i):
                        seen[c] += 1
                        if end:
                            ended[c] += end
            if len(seen) > _FLUSH:
                yield out()
        if seen:
            yield out()

    c = rows.mapInPandas(contexts, "c string, seen long, ended double")
    c = c.groupBy("c").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    return EndModel(Words(known, common), work.put(c.where("seen > 1"), "contexts"))


def truncated(words: Words, field: str, reply: str) -> bool | str:
    """Whether the text breaks off: by an open bracket or half a known word, or not, by a proper end. Else the key of
    its last words, as texts may hardly ever end after them."""
    if unclosed(reply):
        return True
    body, proper = stripped(reply)
    tokens = tokens_of(body)
    if proper or not tokens or (closed(reply) and not body.endswith(("...", "…"))):
        return False
    if tokens[-1] in ",;:-–—&/+(":
        return True
    if len(tokens) > 3 and tokens[-1][0].isalpha() and words.fragment(tokens[-1]):
        return True
    return words.end_key(field, tokens)


# ---------------------------------------------------------------- operator


def reply_defects(
    pairs: DataFrame,
    languages: LanguageModel,
    refusals: RefusalModel,
    ends: EndModel,
    record_id: str = "record_id",
    question: str = "question",
    fields: tuple[str, ...] = ("answer", "explanation"),
) -> DataFrame:
    """(``record_id``, field_name, defect): one row for each field that is no usable reply, none for good ones.

    A missing field (null, blank, stand-in) is ``empty``. With a missing question only ``empty``, ``refusal`` and
    ``truncated`` can be told. Whole texts are read, however long; repeated rows are judged each; other columns are
    not read. Rows are judged where they lie; of a text whose end must be weighed only the key of its last words is
    shuffled, to meet the keys after which texts hardly ever end. Keys that many rows share are salted.
    """
    work = Stages(pairs.sparkSession, "defects")
    sent = pairs.sparkSession.sparkContext.broadcast((languages, refusals, ends.words))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, rm, words = sent.value
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                q = plain(row[1]) if isinstance(row[1], str) else ""
                ask = Prompt(lm, q) if not missing_py(q) else None
                for name, raw in zip(fields, row[2:]):
                    raw = raw if isinstance(raw, str) else None
                    if missing_py(raw):
                        out.append((row[0], name, "empty", None))
                        continue
                    t = plain(raw)
                    if ask and copies(ask, t):
                        out.append((row[0], name, "copied_question", None))
                    elif refuses(rm, t):
                        out.append((row[0], name, "refusal", None))
                    elif ask and speaks_otherwise(lm, ask, t):
                        out.append((row[0], name, "other_language", None))
                    elif broken := truncated(words, name, t):
                        out.append((row[0], name, "truncated", None if broken is True else broken))
            if out:
                yield pd.DataFrame(out, columns=["id", "field_name", "defect", "end"])

    kind = pairs.schema[record_id].dataType.simpleString()
    got = pairs.select(record_id, question, *fields).mapInPandas(judge, f"id {kind}, field_name string, defect string, end string")
    got = work.put(got, "judged")
    open_ = got.where("end is not null")
    broken = ends.p_end(open_.select("end").distinct()).where(F.col("p") < END_BELOW)
    broken = broken.select("end", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("id", "field_name"), F.lit(SALTS)).cast("int"))
    cols = ["id", "field_name", "defect"]
    out = got.where("end is null").select(*cols).unionByName(open_.join(broken, ["end", "salt"], "left_semi").select(*cols))
    return out.withColumnRenamed("id", record_id)
