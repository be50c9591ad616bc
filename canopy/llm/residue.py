"""Template residue and error-page text: trusted seeds, near-duplicate passages by SimHash, labels through components.

Null, empty and blank texts are no residue. Repeated rows count once; extra columns are dropped; an empty table gives an
empty result.

A text is cut into units (sentences and lines). A unit is a trusted seed if, as a whole, it is an unfilled placeholder,
filler, an error message or a notice that scripts are needed; neutral if it is a title, navigation or markup; else own
content. What stands in code spans, code blocks or quotation marks is quoted, hence own content at first.

Units are compared in a plain form (lower-case words, placeholders and numbers masked). Equal ones are one node. Nodes whose
SimHashes of five-word shingles are at most HAMMING bits apart and which share at least SIMILARITY of their shingles are
linked; tables partitioned by some of the bits find the pairs of a seed, or of what a seed has reached, and any other node. A component takes the seeds' label if they are at least half of its nodes. With these labels all units of all texts
are counted again: a text is residue if its residue clearly outweighs its own content.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.arrow import Hashes, map_rows, words
from canopy.session import cut, cut_counted, small

#: Units that share 0.8 of their shingles differ in 10 of 64 bits on average, and one pair in twenty in more than 14. Two
#: nodes meet in a table if they agree in all of its PART bits; at 10 differing bits TABLES tables find 97 % of the pairs, at
#: 5 all but one in 40,000.
HAMMING, SIMILARITY, SHINGLE, TABLES, PART = 14, 0.8, 5, 28, 11
#: With fewer words a unit has fewer than 4 shingles, so it shares less than SIMILARITY of them with any other unit.
LEAST_WORDS = 8

# Words of the customary filler text.
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())

# Unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\$\{\w[\w .-]{0,40}\}|\{[A-Za-z]\w{0,40}\}|%%[\w -]{1,40}%%|(?<!\w)%[A-Z][A-Z_]+%|(?<!\w)__[A-Z][A-Z_]*__(?!\w)|\[\[[^\[\]\n]{1,60}\]\]|<%=?[^%\n]{0,60}%>|<<\w[\w ]{0,40}>>|@@[\w ]{1,40}@@|##[A-Z_]{2,40}##"
    r"|\[[A-Za-z][^\[\]\n]{0,80}\](?!\()|<[A-Za-z][\w-]*(?:[ _][\w-]+){0,6}>|(?<!\w)X{3,}(?!\w)|_{4,}|(?<!\w)\?{3,}(?!\w)"
)

# Filler and stand-in text, error pages, notices that scripts are needed. A unit has to begin like this.
FILLER = r"""
(?:your|my|some|insert|enter|add|type|put|place) (?:\w+ ){0,4}(?:text|content|title|description|name|summary|message)s? (?:goes |comes |belongs )?(?:here|in this place)
|(?:add|insert|describe|write|list|enter|explain|give|fill in|replace|tick|attach|link) (?:\w+ ){0,8}(?:here|(?:in|at) this (?:place|section|paragraph|line|spot))[.!]?\s*$
|replace this (?:text|paragraph|section|line|sentence)|add (?:a|the|your) (?:\w+ ){0,4}(?:steps?|outcome|summary|details?|description|result|change)s?\W*$
|(?:this is )?(?:a |an )?(?:sample|placeholder|dummy|example|filler|stand-?in|blind) (?:text|content|paragraph|copy|description)
|(?:this|the) (?:section|page|paragraph|part|chapter|text|document) (?:is |was |has been )?(?:intentionally|deliberately|still|currently) (?:left )?(?:blank|empty|unfinished)
|(?:this|the) (?:section|page|document|paragraph|text) (?:will be|is to be|has yet to be|needs to be|is yet to be|is being|is not yet|has not been|hasn't been)\b
|(?:to be (?:done|determined|announced|written|added|defined|completed|confirmed)|tbd|tba|tbc|todo|fixme|wip|n/?a|coming soon|under construction|work in progress)\b[^.]{0,40}\W*$
|(?:more |further )?(?:content|description|documentation|docs|details?|text|information) (?:is |are )?(?:pending|to follow|to come|coming|missing|will (?:be|follow))
|no (?:content|description|text|documentation|summary) (?:has been |was |is )?(?:provided|available|yet|given|entered)
|(?:asdf|qwer|qwerty|hjkl|foo bar|test test|bla bla|blah blah|lorem ipsum|xxx)\b
|hier (?:steht|folgt|kommt|entsteht) (?:später|noch|demnächst|bald|ihr|der)|platzhalter(?:text)?|beispieltext|blindtext|mustertext|bitte ersetzen|texto de (?:ejemplo|exemplo|relleno|muestra|prueba)|sustituir por|substitu(?:a|ir) (?:este|por)
|(?:insert[ae]|inserte|escrib[ae]|escreva|añad[ae]) (?:aquí|aqui)\b|este (?:texto|apartado|parágrafo|párrafo) (?:será|debe|deve)|texte? (?:d'exemple|de remplacement|provisoire|factice|à remplacer|à compléter)|(?:à|a) (?:compléter|remplacer|rédiger|completar|preencher|definir)\b|ins[ée]rez|remplacez|section (?:laissée|à)
|ここに|サンプル(?:テキスト)?|ダミー|仮の|プレースホルダ|準備中|未記入|後で|此处|这里|此處|示例(?:文本|文字)|占位|待补充|待定|待填写|请在此|請在此|在此(?:处|输入|填写)
"""
ERROR = r"""
(?:https?[ /]?(?:1\.[01] )?)?(?:error:?\s*|fehler:?\s*|erreur:?\s*|error\s+|erro:?\s*|エラー:?\s*|错误:?\s*)?(?:4\d\d|5\d\d)(?:\s*[-–—:.|]\s*|\s+)(?:[A-Z]|you\b|the\b|sorry|bad|not|page|forbidden|internal|service|gateway|unauthor|too|request|access|seite|página|erreur|non|no\b|ページ|页|找|$)
|(?:error|fehler|erreur|erro|エラー|错误)\s*:?\s*(?:4\d\d|5\d\d)\b
|(?:internal server error|bad gateway|service (?:is )?(?:temporarily )?unavailable|gateway time-?out|page not found|not found\W*$|file not found|access denied|permission denied|forbidden\W*$|unauthori[sz]ed|too many requests|request timed? ?out|bad request|proxy error|site not found|server error|application error|database error)
|(?:the|this|that) (?:requested |docs? |web ?)?(?:page|url|resource|document|file|article|address|link|server|site|repository|host)(?: you (?:requested|are looking for|were looking for|tried to open|asked for))? (?:on this server )?(?:could not|cannot|can't|was not|is not|does not|doesn't|did not|has been (?:moved|deleted|removed)|is (?:currently |temporarily )?(?:unavailable|down|overloaded)|returned|encountered|no longer|took too)
|(?:oops|sorry|uh-oh|whoops|we're sorry|we are sorry|apologies)\b|something went wrong|an? (?:unexpected |internal |unknown |fatal )?error (?:has )?(?:occurred|happened)|traceback (?:has been|was) sent|incident [0-9a-f]{4,}
|(?:it|this|the page) may have been (?:moved|deleted|removed|renamed)|(?:please )?try again (?:in|later|after)|return to (?:the )?(?:start|home|previous)|you (?:do not|don't|are not|have been|have reached|must be|need to (?:sign|log)|need permission|lack)|your (?:session|login|request|connection|ip|access) (?:has|have|was|is|could)|please (?:sign|log) in|wait \d+ seconds|rate limit|access to this (?:page|resource)|could not (?:connect|resolve|reach|load)|unable to (?:connect|load|reach)|connection (?:timed out|refused|reset)|under maintenance|down for maintenance|we(?:'ll| will) be (?:back|right back)
|\{\s*"(?:status|error|code|message|errors|detail|fault)"\s*:
|(?:die |diese )?(?:seite|angeforderte|der angeforderte|die angeforderte|die gesuchte)\b.{0,60}(?:nicht|verschoben|gelöscht)|(?:interner serverfehler|zugriff verweigert|dienst nicht|ihre sitzung|sitzung abgelaufen|bitte versuchen sie es|bitte melden sie sich)
|(?:la |cette )?page .{0,50}(?:introuvable|n'existe|n’existe|n'a pas|n’a pas|supprimée|déplacée)|(?:page introuvable|erreur interne|accès (?:refusé|interdit)|service indisponible|votre session|veuillez (?:vous connecter|réessayer))
|(?:la |esta )?página .{0,50}(?:no |não |eliminad|removid)|(?:p[áa]gina (?:no|não) encontrad|error interno|erro interno|acceso denegado|acesso negado|servicio no|serviço indispon|su sesión|sua sessão|vuelva (?:al|a)|volte (?:ao|para)|inténtelo|tente novamente)
|(?:お探しの|ご指定の|指定された|要求された)?(?:ページ|サーバー|アクセス|セッション).{0,30}(?:見つかりません|エラー|拒否|できません|切れ|ありません|移動|削除)|お探しの|ご不便|しばらく|再度|(?:抱歉|对不起|很抱歉)|(?:您(?:访问|请求|要找|查找)的?)?(?:页面|頁面|网页|网站|服务器|会话|访问).{0,20}(?:不存在|未找到|找不到|无法|错误|拒绝|过期|出错|被拒|已被)|请稍后|请重新(?:登录|加载)
"""
SCRIPTS = r"""
(?:please |you (?:need to|must|have to|should) )?(?:enable|allow|turn on|activate|switch on) (?:your )?(?:java\s?script|scripts?|cookies)\b|java\s?script (?:is|must|has to|needs|seems|appears|required|disabled|and cookies)\b|scripts? (?:and cookies )?(?:is|are|must|have to)\b
|(?:this|the|our) [\w -]{0,40}(?:requires?|needs?|(?:(?:only |best )?(?:works?|starts?|runs?|opens?|loads?) )?(?:best |only )?with|depends on|uses|cannot be (?:shown|displayed)[\w ]{0,20} without|does(?: not|n't) work without|will not work without) (?:java\s?script|scripts)|your browser (?:does|has|is|must|needs|seems|will)\b|checking your browser|loading\W{1,8}(?:if |please |\.)|loading\W*$|turn it on in your browser|some parts of .{0,60} without (?:scripts|java\s?script)|<noscript|if (?:nothing|you can read|you see this|this page does)\b.{0,60}(?:scripts?|java\s?script|reload)
|(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:bitte )?(?:java\s?script|skripte)|java\s?script (?:ist|muss|wird)|(?:diese|die) (?:seite|anwendung|ansicht) .{0,40}(?:java\s?script|skripte)|(?:veuillez |merci d')?(?:activer|activez) java\s?script|java\s?script (?:est|doit)|(?:cette|la) page .{0,40}java\s?script|(?:por favor,? )?(?:active|habilite|activa|ative) (?:el |o )?java\s?script|java\s?script (?:está|debe|deve|é)|(?:esta|a|la) página .{0,40}java\s?script
|java\s?script\s*(?:を|が|は)|.{0,40}java\s?script\s*(?:を|が)?\s*(?:有効|必要|オン)|(?:请|請).{0,12}java\s?script|.{0,40}(?:需要|启用|啟用|开启|禁用).{0,8}java\s?script
"""
NEUTRAL = re.compile(
    r"(?:[^\W\d_][\w' ]{0,24}\s*[|›»>·•/]\s*)+[\w' ]{1,24}$|(?:skip to|back to|go to|jump to|zurück|retour|volver|voltar|table of contents|contents|menu|navigation|home|search|sign (?:in|up)|log ?in|next|previous|breadcrumb)\b[\w ]{0,30}$|(?:\(c\)|©|copyright).{0,80}$|all rights reserved|powered by|last (?:updated|modified)|[-=*_~|:\s]{2,}$|\W*$",
    re.I,
)
_COMPILED = [re.compile("(?:" + "".join(line.strip() for line in p.strip().splitlines()) + ")", re.I) for p in (FILLER, ERROR, SCRIPTS)]
_NOSCRIPT = re.compile("<noscript>", re.I)
_MASKED = re.compile(PLACEHOLDER.pattern + r"|«[^«»\n]{1,60}»")
_HINT = re.compile(r"[{\[<%_@#?X«]")  # without one of these there is no placeholder
_NUMBERED = re.compile(r"\d")
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_SPAN = re.compile(r"`[^`\n]+`|“[^”\n]*”|«[^»\n]*»|„[^“\n]*“|\"[^\"\n]{3,}\"")
_TAG = re.compile(r"</?(?:html|head|title|body|center|h[1-6]|p|div|span|br|hr|pre|b|i|em|strong|a|ul|ol|li|address|main|header|footer|section|nav|meta|link|style|table|tr|td|th|img|button|form|input|label|iframe)\b[^<>]*>|<!doctype[^>]*>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"')\]])\s+|(?<=[。！？])|[\r\n\v\f\u2028\u2029]+")
_UNSEEN = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\x00-\x08\x0e-\x1f\x7f]")
_MARK = re.compile(r"^\s*(?:[-*+•>#]+|\d+[.)]|\|)\s*")
_PROMPT = re.compile(r"^(?:>\s*[^.]*|_[^_.]+_|\*[^*.]+\*|\([^().]+\)|<!--[^.]*-->|\{[^{}.]+\}|\[[^\[\].]+\]|-\s*\[ ?\].*)$")
_COMMENT = re.compile(r"<!--\s*(.*?)\s*-->", re.S)
_LEAD = re.compile(r"^(?:\W|_)+")
_OPENERS = re.compile(r"^(?:warning|note|notice|error|hinweis|achtung|attention|nota|aviso|info)\s*[:!-]\s*", re.I)


def units(text: str) -> tuple[int, int, list[tuple[int, str, list[str] | None]]]:
    """Residue and own content that is no unit, and the units: weight as residue, or -1 for own content, text, and its words if known."""
    text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    if text.lstrip().startswith("{") and len(text) < 600 and _COMPILED[1].match(text.lstrip()):
        return 1, 0, []
    fenced = text.count("```") + text.count("~~~") and len(_FENCE.findall(text))
    if fenced:
        text = _FENCE.sub("\n", text)
    if "<" in text:
        text = _TAG.sub("\n", _NOSCRIPT.sub("\n<noscript>", _COMMENT.sub(r"(\1)", text)))
    out: list[tuple[int, str, list[str] | None]] = []
    titled = False
    for unit in _SENTENCE.split(text):
        unit = unit.strip()
        if not unit:
            continue
        body = _MARK.sub("", unit)
        bare = _SPAN.sub(" ", body) if not body.startswith("<noscript") else body
        marks = PLACEHOLDER.findall(bare) if _HINT.search(bare) else ()
        found = words(bare)
        whole = found if bare == body else words(body)
        n = len(whole)
        low = _OPENERS.sub("", _LEAD.sub("", bare) if not bare.startswith(("{", "<noscript")) else bare)
        if marks and len(words(PLACEHOLDER.sub(" ", bare))) <= max(4, 7 * len(marks)) and not (len(marks) == 1 and bare is not body and "`" in body):
            out.append((1, body, whole))
        elif any(p.match(low) for p in _COMPILED):
            out.append((1, body, whole))
        elif n >= 3 and sum(w in LOREM for w in found) >= 0.7 * len(found) > 0:
            out.append((1 + n // 30, body, whole))
        elif 0 < n <= 9 and _PROMPT.match(unit):
            out.append((1, body, whole))
        elif unit.startswith("#") or NEUTRAL.match(body) or n <= 2 or (n <= 6 and body.endswith(":")):
            # Neutral, unless what it looks like elsewhere is residue: a masked word or two may be all of it.
            if _HINT.search(body) and _MASKED.search(body):
                out.append((0, body, whole))
        elif not titled and not out and not fenced and n <= 9 and not re.search(r"[.!?。！？:]\s*$", body):
            titled = True
        else:
            out.append((-1, body, whole))
    return 0, 2 * fenced, out


def judge(text: str) -> tuple[int, int]:
    """Residue and own content in `text` by the seeds alone."""
    residue, own, found = units(text)
    return residue + sum(w for w, *_ in found if w > 0), own + sum(w < 0 for w, *_ in found)


def plain_words(unit: str, known: list[str] | None = None) -> list[str]:
    """Words of a unit (`known`, if they are), with placeholders masked by one letter and words with digits by `0`."""
    found = words(_MASKED.sub(" \u01c2 ", unit)) if known is None or _HINT.search(unit) else known
    return [w if w.isalpha() else "0" if _NUMBERED.search(w) else w for w in found] or [unit]


def is_seed(residue: int, own: int) -> bool:
    return residue > 0 and (own == 0 or own == 1 or residue >= 3 * own)


def shingles(found: list[str], memo: Hashes) -> np.ndarray:
    """Hashes of the distinct five-word shingles; a shorter text is one shingle."""
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    return np.unique(_hashed(np.pad(h, (0, max(0, SHINGLE - len(h)))))) if len(h) else h


def _hashed(h: np.ndarray) -> np.ndarray:
    """Hash of each run of SHINGLE word hashes."""
    g = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        g = (g ^ h[k : k + len(g)]) * np.uint64(0x9E3779B185EBCA87)
        g ^= g >> np.uint64(31)
    return g


def simhashes(texts: list[list[str]], memo: Hashes) -> np.ndarray:
    """SimHash of the shingles of each list of words, none of which is empty."""
    if not texts:
        return np.empty(0, np.int64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    padded = np.maximum(n, SHINGLE)
    ends = np.cumsum(padded)
    h = np.zeros(ends[-1], np.uint64)
    own = np.arange(ends[-1]) - np.repeat(ends - padded, padded) < np.repeat(n, padded)
    h[own] = np.fromiter((memo[w] for t in texts for w in t), np.uint64, int(n.sum()))
    inside = np.repeat(ends, padded)[: len(h) - SHINGLE + 1] - np.arange(len(h) - SHINGLE + 1) >= SHINGLE
    bits = np.unpackbits(_hashed(h)[inside].view(np.uint8).reshape(-1, 8), axis=1)
    count = padded - SHINGLE + 1
    ones = np.add.reduceat(bits, np.cumsum(count) - count, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > count[:, None], axis=1).view(np.int64).ravel()


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(`id`, `residue`, `own`, `node`, `weight`, `sim`) of each text that is not blank: counts, and its units as arrays.

    Units of fewer than LEAST_WORDS words have no SimHash.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = run.__dict__.setdefault("memo", Hashes())
        residue, own, sizes, weight, node, forms, long = [], [], [0], [], [], [], []
        for t in batch.column(1).to_pylist():
            r, o, found = units(t)
            residue.append(r)
            own.append(o)
            for w, u, known in found:
                form = plain_words(u, known)
                weight.append(w)
                node.append(xxhash.xxh64_intdigest(" ".join(form)) - (1 << 63))
                long.append(len(form) >= LEAST_WORDS)
                if long[-1]:
                    forms.append(form)
            sizes.append(len(node))
        sims = np.zeros(len(node), np.int64)
        sims[np.array(long, bool)] = simhashes(forms, memo)
        sims = pa.array(sims, pa.int64(), mask=~np.array(long, bool))
        lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, k)) for x, k in ((node, pa.int64()), (weight, pa.int32()))]
        lists.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), sims))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(residue, pa.int32()), pa.array(own, pa.int32()), *lists], ["id", "residue", "own", "node", "weight", "sim"])

    texts = df.select(key, text).where(f"`{key}` is not null and length(trim(`{text}`)) > 0")
    return map_rows(texts, run, f"id {dict(df.dtypes)[key]}, residue int, own int, node array<bigint>, weight array<int>, sim array<bigint>")


def _masks() -> list[int]:
    rng = np.random.default_rng(11)
    return [sum(1 << int(i) for i in rng.choice(64, PART, replace=False)) for _ in range(TABLES)]


def _tables(nodes: DataFrame) -> DataFrame:
    """Each node once for each table."""
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("sim").bitwiseAND(F.lit(signed(m)).cast("bigint"))) for i, m in enumerate(_masks())))
    return nodes.select("node", "sim", F.explode(keys).alias("bucket"))


def near_links(seeds: DataFrame, others: DataFrame, n: int) -> DataFrame:
    """(`a`, `b`): the pairs of a node of `seeds` (counted: `n`) and another one of `others` within HAMMING bits that meet in a table."""
    left = small(_tables(seeds).select(F.col("node").alias("a"), F.col("sim").alias("at"), "bucket"), TABLES * n)
    pairs = _tables(others).join(left, "bucket").where((F.bit_count(F.col("sim").bitwiseXOR(F.col("at"))) <= HAMMING) & (F.col("node") != F.col("a")))
    return pairs.select("a", F.col("node").alias("b")).distinct()


def verified(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (`a`, `b`) whose units (`node`, `form`) share at least SIMILARITY of their shingles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        memo = Hashes()
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = shingles(x.split(" "), memo), shingles(y.split(" "), memo)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both >= SIMILARITY * (len(p) + len(q) - both))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = links.join(texts.withColumnsRenamed({"node": "a", "form": "x"}), "a").join(texts.withColumnsRenamed({"node": "b", "form": "y"}), "b").select("a", "b", "x", "y")
    return map_rows(pairs, run, "a bigint, b bigint", 256)


def forms_of(df: DataFrame, key: str, text: str, nodes: DataFrame, n: int) -> DataFrame:
    """(`node`, `form`) of the nodes (`node`, `id` of a text that has it; counted: `n`): only those texts are read again."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {" ".join(plain_words(u)) for t in batch.column(1).to_pylist() for _, u, _ in units(t)[2]}
        return pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in out], pa.int64()), pa.array(list(out), pa.string())], ["node", "form"])

    where = small(nodes.select(F.col("id").alias(key)).distinct(), n)
    rows = df.select(key, text).where(f"length(trim(`{text}`)) > 0").join(where, key, "left_semi")
    return map_rows(rows, run, "node bigint, form string").join(small(nodes.select("node"), n), "node", "left_semi").dropDuplicates(["node"])


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(`id`, `part`): the smallest id of each node's component. Labels spread along links and then jump to their label's label."""
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    touched = both.select(F.col("a").alias("id")).distinct()
    part = cut(touched.withColumn("part", F.col("id")))
    while True:
        near = both.join(part.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("part").alias("low"))
        lower = part.join(near, "id", "left").select("id", "part", F.least("part", F.coalesce("low", "part")).alias("low"))
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        new = cut(lower.join(jump, "low", "left").select("id", "part", F.least("low", F.coalesce("lower", "low")).alias("now")))
        done = not new.where("now < part").limit(1).count()
        part = new.select("id", F.col("now").alias("part"))
        if done:
            return nodes.join(part, "id", "left").select(*nodes.columns, F.coalesce("part", "id").alias("part"))


def labels(df: DataFrame, prints: DataFrame, key: str, text: str) -> DataFrame:
    """(`node`) of the units that no seed pattern knows everywhere, but that are residue by their component."""
    each = prints.select("id", F.explode(F.arrays_zip("node", "weight", "sim")).alias("u")).select("id", "u.node", "u.weight", "u.sim")
    nodes = each.groupBy("node").agg(F.first("sim").alias("sim"), F.min("id").alias("id"), F.max(F.col("weight") > 0).alias("trusted"), F.min("weight").alias("least"))
    nodes = cut(nodes)
    frontier, n = cut_counted(nodes.where("trusted and sim is not null").select("node", "sim"))
    others, links = nodes.where("not trusted and sim is not null").select("node", "sim"), None
    while n:
        close, m = cut_counted(near_links(frontier, others, n))
        if not m:
            break
        ends, k = cut_counted(close.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "id"), "node"))
        close = cut(verified(close, cut(forms_of(df, key, text, ends, k))))
        links = close if links is None else links.unionByName(close)
        reached = close.select(F.col("b").alias("node")).distinct()
        frontier, n = cut_counted(others.join(reached, "node", "left_semi"))
        others = cut(others.join(frontier.select("node"), "node", "left_anti"))
    if links is None:
        return nodes.where("trusted and least <= 0").select("node")
    touched = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = components(touched, links).withColumnRenamed("id", "node").join(nodes.select("node", "trusted"), "node")
    guilty = parts.groupBy("part").agg(F.avg(F.col("trusted").cast("int")).alias("share")).where("share >= 0.5").select("part")
    spread = parts.join(guilty, "part", "left_semi").where("not trusted").select("node")
    return nodes.where("trusted and least <= 0").select("node").unionByName(spread)


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", spread: bool = True) -> DataFrame:
    """Distinct (`key`) of the rows whose text is template residue, filler, an error page or a script notice.

    Without `spread` the seeds alone decide.
    """
    prints = cut(fingerprints(df, key, text))
    more = F.aggregate("weight", F.lit(0), lambda n, w: n + F.greatest(w, F.lit(0)))
    less = F.aggregate("weight", F.lit(0), lambda n, w: n + F.when(w < 0, 1).otherwise(0))
    counts = prints.select("id", (F.col("residue") + more).alias("residue"), (F.col("own") + less).alias("own"))
    if spread:
        found, n = cut_counted(labels(df, prints, key, text))
        each = prints.select("id", F.explode(F.arrays_zip("node", "weight")).alias("u")).select("id", "u.node", "u.weight").where("weight <= 0")
        turned = each.join(small(found, n), "node", "left_semi").groupBy("id").agg(F.count("*").alias("more"), F.sum(-F.col("weight")).alias("less"))
        counts = counts.join(turned, "id", "left").select("id", (F.col("residue") + F.coalesce("more", F.lit(0))).alias("residue"), (F.col("own") - F.coalesce("less", F.lit(0))).alias("own"))
    return counts.where("residue > 0 and (own <= 1 or residue >= 3 * own)").select(F.col("id").alias(key)).distinct()
