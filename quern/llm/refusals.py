"""Refusals by grammar: words become categories, and a clause refuses if its categories parse.

A clause needs what fails (a word for it, or a negation together with an ability or a will) or a verb of declining, and
either the act that fails (answering, helping, saying) or an apology or the speaker. Words of no category may make up
a small part only, so clauses about the world don't parse however long or short they are.
"""

from __future__ import annotations

import functools

import regex

# The lexicon. A category's words by language; ``*`` stands for any ending (in front, for any beginning).
# P apology, S speaker, N negation, B ability or will, U failing, D declining, A act, Q what was asked, C sources, R referral, f other function words.
LEXICON = {
    "en": {
        "P": "sorry apolog* unfortunately regret* afraid pardon forgive", "S": "i i'm i'd i'll me my mine myself we we're us our assistant model ai", "N": "not no never nothing don't doesn't didn't isn't aren't beyond without",
        "B": "can could able may might must will would should possible permitted allowed position comfortable willing want wish rather feel capable free", "U": "cannot can't couldn't won't wouldn't unable impossible incapable unwilling", "D": "declin* refus* refrain* abstain*",
        "A": "answer* respond* response* repl* comment* help* assist* say tell provid* give offer* discuss* share shar* information advice", "Q": "this that these it question* request* query topic subject matter* something anything here what", "C": "given text* passage* document* source* material* context record* based from",
        "R": "please ask consult contact specialist* expert* someone else", "f": "the a an to of on in at for with by is am are be being been was were as but and or however do does did so side which you your any have has just kind",
    },
    "de": {
        "P": "leid leider entschuldig* bedau* tut", "S": "ich mir mich wir uns mein* meiner", "N": "nicht nichts kein* nie ohne", "B": "kann können könnte möchte* möglich darf dürfen will wollen lage imstande", "U": "unmöglich außerstande", "D": "ablehn* lehne verweiger* passen abzulehnen",
        "A": "beantwort* antwort* sagen sage geben gebe helfen hilf* auskunft äußern mitteilen machen angaben", "Q": "dies* dazu hierzu darauf das frage* es hier thema anfrage*", "C": "quelle* text* unterlage* gegeben* vorlieg* dokument*", "R": "fragen experten fachleute* bitte",
        "f": "sie der die den dem zu zur auf aus mit bei da als in und aber ihnen ihre ihr muss ab ist bin sind von an eine einen ein im",
    },
    "fr": {
        "P": "désolé* malheureusement regrett* excus* pardon navré*", "S": "je j' j me m' m mon ma nous moi", "N": "ne n' n pas aucun* rien sans", "B": "peux puis pouvons pourrais mesure possible saurais capable veux souhaite", "U": "impossible incapable", "D": "refus* déclin*",
        "A": "répon* aide* fournir donner dire réponse* commenter renseign* conseil*", "Q": "cette ce cet cela ça question* ici sujet demande*", "C": "texte* source* document* fourni* donné*", "R": "spécialiste* expert* veuillez adress*", "f": "à de d' d la le l' l les des du une un vous en il est suis sont que qui sur pour et mais y au",
    },
    "es": {
        "P": "siento lamento perdón disculp* desafortunadamente lamentablemente", "S": "yo me mi nosotros", "N": "no nunca nada sin ningun*", "B": "puedo podemos podría posible capaz quiero", "U": "imposible incapaz", "D": "rechaz* declin* niego",
        "A": "respond* contest* respuesta* ayud* decir* dar proporcion* ofrec* información", "Q": "esta este esto eso pregunta* aquí tema solicitud", "C": "texto* fuente* documento* dado*", "R": "consult* especialista* experto* favor", "f": "lo la el los las a de en con por para que y pero le te se una un es soy estoy esa su",
    },
    "it": {
        "P": "dispiace scusa* purtroppo spiacente", "S": "io mi noi", "N": "non nessun* nulla niente", "B": "posso possiamo potrei possibile grado voglio", "U": "impossibile incapace", "D": "rifiut* declin*",
        "A": "rispond* risposta* aiut* dire dare fornire", "Q": "questa questo ciò domanda* qui argomento richiesta", "C": "testo testi fonte fonti document*", "R": "specialista esperto", "f": "a di da in con per che e ma il la lo le un una è sono ti vi",
    },
    "kn": {
        "P": "ಕ್ಷಮಿಸಿ ವಿಷಾದ*", "S": "ನಾನು ನನಗೆ ನನ್ನ*", "N": "ಇಲ್ಲ ಅಲ್ಲ", "B": "ಸಾಧ್ಯ", "U": "*ಲಾರೆ *ಲಾರೆನು ಸಾಧ್ಯವಿಲ್ಲ ಸಾಧ್ಯವಾಗುತ್ತಿಲ್ಲ ಆಗುತ್ತಿಲ್ಲ ಆಗುವುದಿಲ್ಲ ಆಗದು ಅಸಮರ್ಥ*", "D": "ನಿರಾಕರಿಸ*",
        "A": "ಉತ್ತರ* ಹೇಳ* ಸಹಾಯ* ನೀಡ* ಮಾಡ* ತಿಳಿಸ* ಕೊಡ*", "Q": "ಈ ಇದ* ಅದ* ಪ್ರಶ್ನೆ* ವಿಷಯ* ಬಗ್ಗೆ ಕುರಿತು", "C": "ಕೊಟ್ಟ* ಪಠ್ಯ* ದಾಖಲೆ* ಆಧಾರ*", "R": "ತಜ್ಞ* ಕೇಳಿ ದಯವಿಟ್ಟು", "f": "ಆದರೆ ಮತ್ತು ಎಂದು",
    },
    "hi": {
        "P": "क्षमा खेद माफ़ माफ", "S": "मैं मुझे मेरे मेरी हम", "N": "नहीं मत", "B": "संभव सक* पा*", "U": "असमर्थ असंभव", "D": "मना इनकार इंकार",
        "A": "उत्तर जवाब सहायता मदद देना दे देने कर करने बता* बोल*", "Q": "इस यह इसका प्रश्न* सवाल विषय बारे", "C": "दिए गए पाठ स्रोत दस्तावेज़*", "R": "विशेषज्ञ* पूछ* कृपया", "f": "का की के को से में लिए है हूँ हूं हैं करें पर और कोई भी",
    },
    "ur": {
        "P": "معذرت معاف افسوس", "S": "میں مجھے میرے ہم", "N": "نہیں مت", "B": "ممکن سک* پا*", "U": "قاصر معذور ناممکن", "D": "انکار",
        "A": "جواب مدد دینا دے دینے کر کرنے بتا* کہہ", "Q": "اس یہ سوال* موضوع بارے", "C": "دیے گئے متن ماخذ دستاویز*", "R": "ماہر* پوچھ* براہ", "f": "کا کی کے کو سے لیے ہے ہوں ہیں پر اور کوئی بھی کرم",
    },
    "zh": {"P": "很抱歉 抱歉 对不起 遗憾", "S": "我们 我", "N": "不 没有 没", "B": "能够 能 可以 可能 愿意 愿 便", "U": "无法 不便 不能 难以", "D": "拒绝 谢绝", "A": "回答 作答 回应 答复 帮助 提供 说明 告诉 协助", "Q": "这个 这 此 该 问题 请求 方面", "C": "根据 现有 资料 提供的 文本 来源 上述", "R": "请 咨询 专家", "f": "的 地 得 给 你 您 在 上 为 对 于 就"},
    "ja": {"P": "申し訳ありません 申し訳ございません 申し訳 すみません ごめんなさい 残念ながら 残念", "S": "私に 私 当方", "N": "ありません ません ない", "B": "でき 可能", "U": "できません 出来ません いたしかねます いたしかね 差し控えます 差し控え 答えられません お断り", "D": "拒否 辞退", "A": "お答え 回答 答え 返答 お手伝い 説明 提供", "Q": "この その これ ご質問 質問 件", "C": "与えられた 資料 文書 情報", "R": "専門家 お尋ね ください", "f": "が は に を の から では も と で て し ため させていただきます します です 、"},
    "th": {"P": "ขออภัย ขอโทษ เสียใจ", "S": "ข้าพเจ้า ผม ดิฉัน ฉัน เรา", "N": "ไม่ มิ", "B": "อาจ สามารถ ได้ ขอ อยาก", "U": "ไม่อาจ ไม่สามารถ ไม่ได้", "D": "ปฏิเสธ ขอปฏิเสธ", "A": "ให้คำตอบ คำตอบ ตอบ ช่วยเหลือ ช่วย บอก ให้ข้อมูล", "Q": "คำถาม เรื่องนี้ นี้ เรื่อง", "C": "เอกสาร ข้อความ ที่ได้รับ ข้อมูล", "R": "โปรด ถาม ผู้เชี่ยวชาญ", "f": "จาก ที่ ให้ กับ ของ ใน การ แต่ ครับ ค่ะ"},
}
UNSPACED = ("zh", "ja", "th")
LATIN = ("en", "de", "fr", "es", "it")
#: The share of a clause's words that may be of no category.
STRANGE = 0.2

#: The grammar, over the letters of the categories: something fails within a clause, or something is declined.
_FAILS = "(?:U|N[fAQSCPx]*B|B[fAQSCPx]*N)"
_CLAUSE = regex.compile(f"[PSQCRAfxNB]*(?:{_FAILS}|D)[PSQCRAfxNBUD]*")
_COURTESY = regex.compile("[PSQCRf]+")
_SCRIPT = (("kn", "ಀ-೿"), ("hi", "ऀ-ॿ"), ("ur", "؀-ۿ"), ("th", "฀-๿"), ("ja", "぀-ヿ"), ("zh", "㐀-鿿"))
_SCRIPTS = [(k, regex.compile(f"[{r}]")) for k, r in _SCRIPT]
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’](?:[\p{L}\p{M}]+)?)?")
_SENTENCE = regex.compile(r"(?<=[.!?।॥。۔！？])\s*|\n+")


def _pattern(entry: str) -> str:
    return "".join(r"[\p{L}\p{M}]*" if c == "*" else regex.escape(c) for c in entry)


@functools.cache
def _grammar(language: str) -> tuple[dict[str, regex.Pattern], regex.Pattern, regex.Pattern]:
    """A pattern per category, one that finds any entry (for scripts without spaces), and one that finds what can fail."""
    own = LEXICON[language]
    each = {c: regex.compile("(?:" + "|".join(_pattern(e) for e in sorted(entries.split(), key=len, reverse=True)) + ")", regex.I) for c, entries in own.items()}
    entries = sorted({(e, c) for c, es in own.items() for e in es.split()}, key=lambda x: -len(x[0]))
    any_ = regex.compile("|".join(regex.escape(e) for e, _ in entries))
    cue = regex.compile("|".join(_pattern(e) for c in "NUD" for e in own[c].split()), regex.I)
    return each, any_, cue


@functools.lru_cache(maxsize=200_000)
def _letters(word: str, language: str) -> str:
    """The categories of a word, act before failing; ``x`` for none. A function word that is nothing else is ``f``."""
    each, *_ = _grammar(language)
    found = "".join(c for c in "PSDAQCRNBU" if c in each and each[c].fullmatch(word))
    return found or ("f" if each["f"].fullmatch(word) else "x")


def categories(clause: str, language: str) -> str:
    if language not in UNSPACED:
        return "".join(_letters(w.replace("’", "'"), language) for w in _WORD.findall(clause))
    each, any_, _ = _grammar(language)
    out, at = [], 0
    for m in any_.finditer(clause):
        out.append("x" * ((sum(map(str.isalnum, clause[at : m.start()])) + 1) // 2))
        out.append(next((c for c in "PSDUAQCRNBf" if each[c].fullmatch(m.group())), "x"))
        at = m.end()
    return "".join([*out, "x" * ((sum(map(str.isalnum, clause[at:])) + 1) // 2)])


def parses(letters: str) -> bool:
    """Whether a clause of these categories refuses."""
    if letters.count("x") > STRANGE * len(letters) or not _CLAUSE.fullmatch(letters):
        return False
    told = set(letters)
    return bool("A" in told and told & set("PSQC") or "P" in told and told & set("QSR") or "D" in told and told & set("PSA"))


def languages(clause: str) -> tuple[str, ...]:
    """The languages whose grammar may read a clause, by its script."""
    for k, p in _SCRIPTS:
        if p.search(clause):
            return ("ja", "zh") if k == "zh" else (k,)
    return LATIN


def is_refusal(answer: str | None) -> bool:
    """Every clause of the answer refuses or is mere courtesy, and one refuses. Null and empty answers don't."""
    if not answer or not any(_grammar(k)[2].search(answer) for k in languages(answer)):
        return False
    refused = False
    for clause in _SENTENCE.split(answer):
        if not clause or not clause.strip() or not any(map(str.isalpha, clause)):
            continue
        read = [categories(clause, k) for k in languages(clause) if _grammar(k)[2].search(clause)]
        if any(parses(letters) for letters in read):
            refused = True
        elif not any(_COURTESY.fullmatch(categories(clause, k)) for k in languages(clause)):
            return False
    return refused
