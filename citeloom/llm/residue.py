"""Template residue, filler, error pages and script notices.

Lines are normalised (white space and case folded, digit runs as 0) and counted per host; lines that stand on a fixed
share of a host's pages are its boilerplate. Texts are searched for evidence: unfilled placeholders, filler text, error
messages, notices that scripts are required. The first three count wherever they stand and however often they recur. A
notice that is its host's boilerplate is subtracted where the page has something of its own beside it; where nothing else
is left, it stands in place of the page and counts. All of it runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is boilerplate of a host if with 95 % certainty it stands on this share of its pages or more.
BOILERPLATE_SHARE = 0.2

# What an unfilled field is named (an identifier, or words joined by blanks) and how templates mark it.
_NAME = r"[A-Za-z](?:[\w.\-]|[ _](?=\w)){0,40}"
PLACEHOLDERS = [
    rf"\{{\{{[{{%#]?\s*[#/&>^]?{_NAME}[^{{}}\n]{{0,20}}\}}\}}",
    rf"\{{%-?\s*{_NAME}[^%\n]{{0,40}}%\}}",
    rf"<%=?\s*{_NAME}[^%\n]{{0,40}}%>",
    rf"[$#@]\{{\s*{_NAME}\s*\}}",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"<<\s*{_NAME}\s*>>",
    r"«\s*[A-Za-z](?:[\w.\-]|[ _](?=[A-Z])){0,40}\s*»",
    r"%[A-Za-z][\w.\-]{1,40}(?: [A-Z][\w.\-]*)?%",
    rf"@@\s*{_NAME}\s*@@",
    r"(?<![\w$])\$[A-Za-z][\w.\-]{1,40}(?: [A-Z][\w.\-]*)?\$(?![\w$])",
    r"\{[a-z]{3,}[a-z0-9]*(?:[_.][a-z0-9]{2,})+\}",
    r"<\?(?:php|=)\s[^\n<>]{1,80}",
    r"%[0-9]\$[sd]",
    r"\[object Object\]",
    r"<INSERT[ _][^<>\n]{1,60}>",
    r"\[(?:INSERT|FILL[\s_]?IN|ENTER)[\s_]?[^\[\]\n]{1,60}\]",
    r"\[(?:Insert|Enter|Fill[\s_][Ii]n|Your|YOUR)[\s_][^\[\]\n]{1,60}\]",
    r"\[isi[\s_]?[^\[\]\n]{1,60}di[\s_]?sini\]",
    r"(?iu:\[bitte[\s_]?[^\[\]\n]{0,60}(?:erg[aä]nzen|einf[uü]gen|ausf[uü]llen)\])",
    r"\[ระบุ[\s_]?[^\[\]\n]{1,60}\]",
    r"\[[àÀ][\s_]?compl[ée]ter[^\[\]\n]{0,60}\]",
    r"\[[A-Za-z][^\[\]\n]{0,50}[\s_]?HERE\]",
]

# The grammar of what stands in place of content. A blank between words is any white space or underscores; "~" is white
# space that may be missing.
_THING = "(?:text|content|copy|title|heading|headline|name|paragraph|caption|description)"
FILLER = [
    r"lorem ipsum\b",
    r"(?<again>[^\W\d_]{2,12})(?:[,.]? \k<again>){2,}\b",
    r"(?:asdf|sdfg|zxcv|hjkl|qwer)\w*(?: (?:asdf|sdfg|zxcv|hjkl|qwer)\w*)+",
    rf"(?:your|some|dummy|sample|placeholder|filler) {_THING}s?(?: goes| comes| will go| will be)? here\b",
    rf"(?:insert|add|enter|type|put|write|place|paste) (?:your |some |the )?{_THING}s? here\b",
    r"(?:place~holder|filler|dummy) (?:text|copy|content|paragraph)\b",
    r"(?:sample|example|demo) (?:text|copy|content|paragraph)[,:;]? (?:to be replaced|to replace|please replace|replace|delete|remove|for layout)\b",
    r"(?:hier steht (?:ein )?)?(?:blind|platzhalter|füll|muster|beispiel)text\b",
    r"(?:texte (?:de remplissage|factice|provisoire|à remplacer|d['’]exemple)|faux texte)\b",
    r"(?:teks (?:contoh|pengisi|sementara)|contoh teks)\b",
    r"ข้อความ(?:ตัวอย่าง|จำลอง|แทนที่)",
]
# Words of pseudo-Latin filler; and endings of Latin words that other languages of the corpus seldom have in a row.
PSEUDO_LATIN = "lorem ipsum dolor amet consec adipis elit tempor labore magna aliqua minim nostru quis ullam velit cillum".split()
LATIN_ENDINGS = "(?:(?<!o)us|um|unt|untur|ibus|atur|itur|iste|orem|tatem|(?:ia|na|ga|i)tis|mnis)"

_NO_PAGE = "(?:has (?:been )?(?:moved|removed|deleted)|(?:could|can)~(?:not|n['’]t|['’]t) be (?:found|displayed|loaded|reached)|(?:was|is) not (?:found|available)|isn['’]t available|no longer exists|does(?: not|n['’]t) exist|(?:may|might) have been)"
_REASON = r"(?:(?:the )?(?:page |file |file or directory |url |resource )?(?:was |could )?not (?:be )?found|forbidden|bad gateway|bad request|unauthori[sz]ed|(?:the )?service (?:is )?(?:temporarily )?unavailable|internal (?:server )?error|(?:gateway|request) time-?~out|too many requests|method not allowed|gone|access (?:is )?denied|seite nicht gefunden|zugriff verweigert|interner (?:server)?fehler|page introuvable|non trouvé|accès (?:refusé|interdit)|tidak dijumpai|akses ditolak|ไม่พบ[^\s]{0,40})"
_ERROR_WORD = "(?:error|fehler|erreur|ralat|ข้อผิดพลาด)"
#: Messages in place of a page: a status with its reason, a page that isn't there, access, sessions, failing programs.
ERROR_MESSAGES = [
    rf"(?:https?(?:/[12](?:\.[01])?)?~)?(?:status )?{_ERROR_WORD}?~[:#]?~[45]\d\d(?:\.\d+)?~[:.–—-]*~\(?(?:http )?(?:error)?[:,]?~{_REASON}\)?",
    rf"(?:http )?{_ERROR_WORD}~[:#]?~[45]\d\d",
    rf"{_ERROR_WORD}~[45]\d\d~[:–—-]~[^\r\n.!]{{0,60}}(?:error|fehler|erreur|ralat|ผิดพลาด)[^\r\n.!]{{0,40}}",
    r"(?:internal server error|bad gateway|(?:gateway|request) time-?~out|(?:the )?service (?:is )?(?:temporarily )?unavailable|page not found|file or directory not found)",
    rf"(?:error~:~|sorry~,? |oops~[,!.]? |we['’]re sorry~,? |we are sorry~,? |but )*(?:(?:the|this|that|your) )?(?:requested (?:page|file|url|resource|document|address)|web~page|page|url)(?: you(?:['’]re| are| were|['’]ve| have)?(?: requested| looking for| wanted| followed| tried to reach)?)? {_NO_PAGE}[^\r\n.!]{{0,80}}",
    r"access (?:to [^\r\n.]{1,60} )?(?:is |was |has been )?(?:denied|forbidden)",
    r"you (?:do not|don['’]t) have (?:permission|access) to (?:access|view|open)[^\r\n.!]{0,80}",
    r"too many requests\.?(?: (?:please )?try again later)?",
    r"(?:your |the )?session (?:has |is )?(?:expired|timed out)(?:\.? please log~in again)?",
    r"(?:uncaught|unhandled) \w*(?:error|exception)\b[^\r\n]{0,200}",
    r"(?:fatal|parse|syntax|runtime) error~:[^\r\n]{1,200}",
    r"(?:warning|notice|error|exception)~:[^\r\n]{1,160} line \d+",
    r"server error in [^\r\n]{1,60} application",
    r"traceback \(most recent call last\):?",
    r"at [\w$.]{1,120}\([\w$]+\.\w{1,5}:\d+\)",
    r"(?:[a-z_]\w{0,40}\.){2,8}\w{0,40}(?:exception|error)\b[^\r\n]{0,200}",
    r"(?:sqlstate\[|ora-\d{5})[^\r\n]{0,200}",
    r"error establishing a database connection",
    r"(?:database|mysql|sql|server) connection (?:has )?(?:failed|refused|timed out)",
    r"(?:could|can)~not connect to (?:the )?(?:database|server|mysql|host)[^\r\n.!]{0,100}",
    r"an? (?:unexpected|internal|unknown|application) (?:server )?error (?:has )?occurred[^\r\n.!]{0,80}",
    r"this site can['’]t be reached",
    r"seite (?:wurde )?nicht gefunden",
    r"zugriff verweigert(?:\.? bitte melden sie sich an)?",
    r"ihre sitzung ist abgelaufen",
    r"page (?:introuvable|non trouvée)",
    r"accès (?:refusé|interdit)",
    r"votre session a expiré",
    r"halaman (?:ini )?tidak (?:dijumpai|ditemui|ditemukan)",
    r"akses ditolak",
    r"ไม่พบหน้า[^\s.]{0,40}",
]
# What a notice that scripts are needed begins with, and the words of which it holds one of each kind.
_WHO = "(?:please|you |your browser|(?:this|our|the) (?:web~)?(?:site|page|app|application|content)|we |sorry|enable|activate|turn on|switch on|allow|java~script|js |scripts? (?:is|are|must)|to (?:view|use|continue|access|run|see|proceed)|for full functionality|it (?:looks|seems|appears)|looks like|in order to|bitte|ihr browser|sie (?:müssen|benötigen)|(?:diese|unsere) (?:seite|website|anwendung)|veuillez|votre navigateur|vous devez|(?:cette|notre) (?:page|application)|ce site|pour (?:afficher|utiliser|continuer)|sila|anda perlu|pelayar anda|laman |tapak |untuk (?:melihat|menggunakan)|กรุณา|โปรด|เบราว์เซอร์|คุณต้อง|หน้านี้)"
_SCRIPTS = "(?:java~script|(?<![a-z])js(?![a-z])|(?<![a-z])scripts?(?![a-z])|จาวาสคริปต์|สคริปต์)"
_WANTED = "(?:enabl|activ|disabl|turn(?:ed)? (?:on|off)|switch(?:ed)? (?:on|off)|requir|needs? |must |support|allow|without|works? (?:only|best)|block|aktiv|einschalt|benötig|erforder|nécessa|requis|désactiv|aktif|hidup|perlu|dimatikan|เปิด|ต้อง)"
_GAP = r"(?:[^.!?\r\n]|\r?\n(?![\r\n])){0,160}?"
SCRIPT_NOTICES = [
    rf"(?={_WHO})(?={_GAP}{_SCRIPTS}){_GAP}{_WANTED}",
    r"(?:we are )?checking (?:if )?your browser\b",
    r"verify(?:ing)? (?:that )?you are (?:a )?human",
]


def _either(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def _flexible(patterns: list[str]) -> list[str]:
    """Patterns whose words blanks, underscores or a line break may part."""
    return [p.replace(" ", r"[\s\u00A0_]++").replace("~", r"[\s\u00A0_]*+") for p in patterns]


#: Where a message begins: at the start of a line or a sentence, after markup. Inside a sentence it is wording about it.
_SENTENCE_START = r"(?imu)(?:^|[.!?][ _])[\s_]*+(?:[#>*|-]++[ _])?(?:<[a-z][a-z0-9]{0,9}>)?"
_LATIN = r"(?i)\b(?=[acdeilmnqtuv])" + _either(PSEUDO_LATIN) + r"(?:[\s_]" + _either(PSEUDO_LATIN) + r"){4}\b"
_SCRIPT = _SENTENCE_START + _either(_flexible(SCRIPT_NOTICES))
_LATIN_WORD = rf"(?:[a-z]{{2,12}}{LATIN_ENDINGS}|omnis|iste)\b"
_LATIN_RUN = rf"(?i)\b(?:{_LATIN_WORD}[ ,.]{{1,3}}(?:[a-z]++[ ,.]{{1,3}}){{0,2}}){{3}}{_LATIN_WORD}"
_SIGN = r"[\p{L}\p{N}]"
#: The characters that placeholders begin with, so that other places are passed over at once.
_PLACEHOLDER = r"(?=[\[{<«%@$#])" + _either(PLACEHOLDERS)
_MESSAGE_END = r"(?:</[a-z]|[ \t\u00A0_]*+(?:[.!(\r\n]|$))"


def evidence(raw: Column, notices: bool = True) -> Column:
    """The kind of evidence a text holds, or null: placeholder, script (with ``notices``), error, filler (in this order). Null text: null."""
    filler = raw.rlike(_SENTENCE_START + _either(_flexible(FILLER))) | raw.rlike(_LATIN) | raw.rlike(_LATIN_RUN)
    script = raw.rlike(_SCRIPT)
    error = raw.rlike(_SENTENCE_START + _either(_flexible(ERROR_MESSAGES)) + _MESSAGE_END)
    found = F.when(raw.rlike(_PLACEHOLDER), "placeholder")
    found = found.when(script, "script") if notices else found
    return found.when(error, "error").when(filler, "filler")


def line_key(line: Column) -> Column:
    """A line without case, outer blanks and the values of its digits, as a 64-bit hash."""
    return F.xxhash64(F.trim(F.translate(F.lower(line), "123456789", "000000000")))


def exact_key(line: Column) -> Column:
    """As line_key, but with the values of the digits."""
    folded = F.trim(F.lower(line))
    return F.when(folded.rlike("[0-9]"), F.xxhash64(folded, F.lit(1))).otherwise(line_key(line))


def host_lines(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Normalised and exact lines per host with the number of pages that hold them: host, line (a 64-bit hash; null: all
    pages of the host), pages."""
    lines = F.flatten(F.transform(F.split(F.col(text), r"[\r\n]+"), lambda x: F.array(line_key(x), exact_key(x))))
    every = F.array_union(F.array_distinct(lines), F.array(F.lit(None).cast("long")))
    seen = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.explode(every).alias("line"))
    return seen.groupBy("host", "line").agg(F.count("*").alias("pages"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """host, line: the lines whose share of the host's pages is BOILERPLATE_SHARE or more, by the lower end of Wilson's
    interval of 95 %, so that hosts of a few pages need a larger share; one page alone is none."""
    counted = host_lines(docs, host, text)
    sizes = counted.where(F.col("line").isNull()).select("host", F.col("pages").alias("n"))
    z = 1.645
    n, share = F.col("n"), F.col("pages") / F.col("n")
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return counted.where(F.col("line").isNotNull() & (F.col("pages") > 1)).join(sizes, "host").where(low >= BOILERPLATE_SHARE).select("host", "line")


def find_residue(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, kind of every document with evidence; where that is only notices, with some left after its host's boilerplate
    is subtracted, or with nothing left at all.

    Null and blank texts have none. Rows with the same key are judged each and may both come out. Only documents with
    notices are taken apart into lines.
    """
    suspects = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("raw"), evidence(F.col(text)).alias("kind")
    ).where(F.col("kind").isNotNull())
    furniture = boilerplate(docs, host, text).groupBy("host").agg(F.collect_set("line").alias("furniture"))
    left = suspects.join(furniture, "host", "left")

    def rest(of) -> Column:
        keep = F.filter(F.split("raw", r"[\r\n]+"), lambda x: ~F.coalesce(F.array_contains(F.col("furniture"), of(x)), F.lit(False)))
        return F.array_join(keep, "\n")

    # Lines that differ in their digits alone are content of the page's own, unless they follow a notice it begins with.
    nothing = ~rest(exact_key).rlike(_SIGN) | ~rest(line_key).rlike(_SIGN) & F.col("raw").rlike(r"\A" + _SCRIPT)
    own = F.coalesce(evidence(rest(line_key)), evidence(F.col("raw"), notices=False), F.when(nothing, "script"))
    kind = F.when((F.col("kind") != "script") | F.col("furniture").isNull(), F.col("kind")).otherwise(own)
    return left.select("doc_id", kind.alias("kind")).where(F.col("kind").isNotNull())


def without_residue(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The corpus without the documents that hold residue, all columns kept; null and blank texts stay. Texts without any
    evidence pass where they are; only the few others are joined with what was found. Of rows with the same key and
    evidence, all go if one does."""
    found = find_residue(docs, key, host, text).select(F.col("doc_id").alias("_found")).distinct()
    passed = docs.where(evidence(F.col(text)).isNull())
    doubtful = docs.where(evidence(F.col(text)).isNotNull())
    return passed.unionByName(doubtful.join(found, F.col(key) == F.col("_found"), "left_anti"))
