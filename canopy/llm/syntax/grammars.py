"""The grammars of six languages; see `peg` for the notation."""

from __future__ import annotations

from functools import cache

from canopy.llm.syntax.peg import Grammar

_JS_CONTEXTUAL = "async of get set from as static type interface namespace declare abstract readonly is keyof infer unique satisfies module accessor override public private protected implements asserts global enum let yield await target meta require out package any unknown never object".split()
_JS_RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new null return super switch this throw true false try typeof var void while with".split()


def _script(typed: bool) -> str:
    """JavaScript, or with `typed` TypeScript."""
    soft = " / ".join(f"'{w}'" for w in _JS_CONTEXTUAL)
    hard = " / ".join(f"'{w}'" for w in _JS_RESERVED)
    t = (lambda x: x) if typed else (lambda x: "")
    return f"""
ident = ID / {soft}
name = ID / {soft} / {hard}
stmts = (stmt / ';')*
module = stmts
eos = ';' / NL
bindings = bind (',' bind)*
bind = target {t("'!'?")} ta ('=' assign)?
target = ident / <array> / <object>
ta = {t("(':' type)?") or "EMPTY"}
vars = ('var' / 'let' / 'const' {t("!'enum'")}) bindings
stmt = <stmts> / vars eos / func / class / ifs / loop / 'switch' <paren> <cases> / 'try' <stmts> (('catch' <catchp>? <stmts>) ('finally' <stmts>)? / 'finally' <stmts>) / 'return' (!NL expr)? eos / 'throw' !NL expr eos / ('break' / 'continue') (!NL ident)? eos / 'debugger' eos / imports / exports {t("/ typedecl")} / ident ':' stmt / !('function' / 'class') expr eos
ifs = 'if' <paren> stmt ('else' stmt)?
loop = 'for' 'await'? <forhead> stmt / 'while' <paren> stmt / 'do' stmt 'while' <paren> ';'? / 'with' <paren> stmt
func = decos 'async'? 'function' '*'? ident? {t("tparams?")} <params> tr ({t("eos /")} <stmts>)
tr = {t("(':' type)?") or "EMPTY"}
class = decos {t("'abstract'?")} 'class' ident? {t("tparams?")} ('extends' post {t("targs?")})? {t("('implements' type (',' type)*)?")} <classbody>
decos = ('@' post)*
imports = 'import' (STR / {t("'type'?")} ident ',' (<specs> / '*' 'as' ident) 'from' STR / {t("'type'?")} (<specs> / '*' 'as' ident / ident) 'from' STR {t("/ ident '=' expr")}) (('with' / 'assert') <object>)? eos
assert = ID
exports = decos 'export' ('default' (func / class {t("/ 'interface' ident tparams? ('extends' type (',' type)*)? <typebody>")} / assign eos) / func / class / vars eos {t("/ typedecl")} / {t("'type'?")} ('*' ('as' name)? / <specs>) ('from' STR)? eos {t("/ '=' expr eos / 'as' 'namespace' ident eos")})
specs = {t("'type'?")} spec (',' {t("'type'?")} spec)* ','? / EOF
spec = (name / STR) ('as' (name / STR))?
classbody = (member / ';')*
member = decos <stmts> / decos 'static' <stmts> / decos mods ('get' / 'set')? '*'? key {t("('?' / '!')?")} {t("tparams?")} <params> tr ({t("eos /")} <stmts>) / decos mods key {t("('?' / '!')?")} ta ('=' assign)? (eos / EOF) {t("/ mods <isig> ta eos")}
mods = mod*
mod = ('static' / 'async' / 'accessor' {t("/ 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'declare' / 'override'")}) &(name / NUM / STR / <index> / '*' / <stmts>)
key = name / STR / NUM / <index>
cases = (('case' expr / 'default') ':' (stmt / ';')*)*
catchp = target ta
paren = expr
args = (('...'? assign) (',' '...'? assign)* ','?)?
params = (param (',' param)* ','?)?
param = decos {t("mods")} '...'? ({t("'this' / ")} target) {t("'?'?")} ta ('=' assign)?
forhead = (vars / expr)? ';' expr? ';' expr? / ('var' / 'let' / 'const') target ('of' / 'in') expr / post ('of' / 'in') expr
array = ','* ('...'? assign (','+ '...'? assign)* ','*)?
index = expr
object = (prop (',' prop)* ','?)?
prop = '...' assign / ('async' / 'get' / 'set')? '*'? key {t("tparams?")} <params> tr <stmts> / ('get' / 'set') key <params> tr <stmts> / key ':' assign / ident ('=' assign)?
expr = assign (',' assign)*
assign = arrow / 'yield' (!NL '*'? assign)? / bin ('?' assign ':' assign)? (assignop assign)?
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??=' / '>' '>' '>'? '='
arrow = 'async'? {t("tparams?")} (<params> tr / ident) '=>' (<stmts> / !<stmts> assign)
bin = unary (binop unary {t("/ ('as' / 'satisfies') type")})*
binop = '||' / '&&' / '??' / '|' !'=' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>'? '>'? '='? / '+' / '-' / '**' / '*' / '/' / '%' / 'instanceof' / 'in'
unary = ('!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await') unary / post (!NL ('++' / '--'))?
post = primary suffix*
suffix = '?.' (name / <args> / <index> / STR) / '.' name / <args> / <index> / !NL (STR / template) {t("/ !NL '!' !'=' / targs &<args> <args>")}
primary = 'async' !NL 'function' '*'? ident? {t("tparams?")} <params> tr <stmts> / 'function' '*'? ident? {t("tparams?")} <params> tr <stmts> / class / 'new' ('.' 'target' / !'new' newpost {t("targs?")} <args>? / 'new' newpost) / 'import' (<args> / '.' 'meta') / STR / template / NUM / 'this' / 'super' / 'null' / 'true' / 'false' / <paren> / <array> / <object> / ident
newpost = primary (('.' name) / <index>)*
template = 'FIRST' <paren> ('PART' <paren>)* 'LAST'
""" + (
        f"""
typedecl = decos 'declare'? ('interface' ident tparams? ('extends' type (',' type)*)? <typebody> / 'type' ident tparams? '=' type eos / 'const'? 'enum' ident <enumbody> / ('namespace' / 'module') (ident ('.' ident)* / STR) (<stmts> / eos) / 'global' <stmts>) / 'declare' (vars eos / func / class) / 'abstract' class
tparams = '<' tparam (',' tparam)* ','? '>'
tparam = 'const'? 'in'? 'out'? ident ('extends' type)? ('=' type)?
targs = '<' type (',' type)* ','? '>'
type = 'asserts' ident ('is' type)? / (ident / 'this') 'is' type / union ('extends' union '?' type ':' type)?
union = ('|' / '&')? tprefix (('|' / '&') tprefix)*
tprefix = ('keyof' / 'unique' / 'readonly' / 'infer') !(',' / '>' / ')' / '=') tprefix / 'typeof' post targs? / tprim (!NL <tindex>)*
tprim = tparams? <params> '=>' type / 'abstract'? 'new' tparams? <params> '=>' type / <ptype> / <typebody> / <tuple> / '-'? NUM / STR / 'FIRST' <ptype> ('PART' <ptype>)* 'LAST' / 'this' / 'null' / 'void' / 'true' / 'false' / 'import' <args> ('.' name)* targs? / ident ('.' name)* targs?
ptype = type
tindex = EOF / type
tuple = (tel (',' tel)* ','?)?
tel = '...'? (ident '?'? ':' '...'? type / type '?'?)
isig = ident ':' type / ident 'in' type ('as' type)?
typebody = (tmember (';' / ',' / NL) / ';' / ',')* 
tmember = ('+' / '-')? ('readonly' / 'static')? &(<isig>) <isig> ('+' / '-')? '?'? ta / 'new'? tparams? <params> tr / ('get' / 'set') key <params> tr / ('readonly' &(name / STR / <index>))? key '?'? (tparams? <params> tr / ta)
enumbody = (key ('=' assign)? (',' key ('=' assign)?)* ','?)?
"""
        if typed
        else ""
    )


@cache
def script(typed: bool) -> Grammar:
    brackets = {"(": ["paren", "args", "params", "forhead", "catchp"] + ["ptype"] * typed, "[": ["array", "index"] + ["tindex", "tuple", "isig"] * typed, "{": ["stmts", "object", "classbody", "cases", "specs", "paren"] + ["typebody", "enumbody", "ptype"] * typed}
    return Grammar(_script(typed), brackets, {"stmts", "module", "classbody"} | ({"typebody"} if typed else set()), set(_JS_RESERVED))


_JAVA_SOFT = "record sealed permits non var yield module open with to when".split()
_JAVA_HARD = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
_JAVA = f"""
ident = ID / {" / ".join(f"'{w}'" for w in _JAVA_SOFT)}
qname = ident ('.' annots ident)*
module = (annots 'package' qname ';')? ('import' 'static'? ident ('.' ident)* ('.' '*')? ';' / ';')* (typedecl / ';')*
annot = '@' !'interface' qname <annargs>?
annots = annot*
annargs = (ident '=' annval (',' ident '=' annval)* / annval)?
annval = annot / <anninit> / cond
anninit = (annval (',' annval)* ','?)?
mods = (annot / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !':' !'->' / 'sealed' &(ident / 'class' / 'interface' / 'public' / 'abstract') / 'non' '-' 'sealed')*
typedecl = mods ('class' ident tparams? ('extends' type)? ('implements' types)? ('permits' types)? <cbody> / 'interface' ident tparams? ('extends' types)? ('permits' types)? <cbody> / 'enum' ident ('implements' types)? <ebody> / 'record' ident tparams? <params> ('implements' types)? <cbody> / '@' 'interface' ident <cbody>)
types = type (',' type)*
tparams = '<' annots ident ('extends' type ('&' type)*)? (',' annots ident ('extends' type ('&' type)*)?)* '>'
targs = '<' (targ (',' targ)*)? '>'
targ = annots ('?' (('extends' / 'super') type)? / type)
prim = 'int' / 'long' / 'double' / 'float' / 'boolean' / 'char' / 'byte' / 'short'
type = annots (prim / cname) dims
cname = ident targs? ('.' annots ident targs?)*
dims = (annots <empty>)*
cbody = (member / ';')*
member = mods tparams? (type / 'void') ident <params> dims throws? (<stmts> / ('default' annval)? ';') / mods tparams? ident <params> throws? <stmts> / mods type vars ';' / typedecl / 'static'? <stmts> / mods ident <stmts>
throws = 'throws' types
vars = var (',' var)*
var = ident dims ('=' init)?
init = <arrinit> / expr
arrinit = (init (',' init)* ','?)?
ebody = (econst (',' econst)* ','?)? (';' (member / ';')*)?
econst = annots ident <args>? <cbody>?
params = (param (',' param)*)?
param = mods type '...'? (ident ('.' 'this')? / 'this') dims
stmts = (bstmt / ';')*
bstmt = mods type vars ';' / stmt / typedecl
stmt = <stmts> / 'if' <paren> stmt ('else' stmt)? / 'for' <forhead> stmt / 'while' <paren> stmt / 'do' stmt 'while' <paren> ';' / 'switch' <paren> <cases> / 'try' (<resources> <stmts> ('catch' <catchp> <stmts>)* ('finally' <stmts>)? / <stmts> (('catch' <catchp> <stmts>)+ ('finally' <stmts>)? / 'finally' <stmts>)) / 'return' expr? ';' / 'throw' expr ';' / 'break' ident? ';' / 'continue' ident? ';' / 'yield' !('=' / '.' / '++' / '--' / <args>) expr ';' / 'synchronized' <paren> <stmts> / 'assert' expr (':' expr)? ';' / ident ':' stmt / expr ';' / ';'
paren = expr
args = (expr (',' expr)*)?
forhead = (mods type vars / expr (',' expr)*)? ';' expr? ';' (expr (',' expr)*)? / mods type ident ':' expr
resources = res (';' res)* ';'?
res = mods type ident '=' expr / qname
catchp = mods type ('|' type)* ident
cases = (('case' label (',' label)* ('when' expr)? / 'default') (':' (bstmt / ';')* / '->' (<stmts> / 'throw' expr ';' / expr ';')))*
label = 'default' / pattern / cond
pattern = mods type (<recpat> ident? / ident)
recpat = (pattern (',' pattern)*)?
empty = EOF
index = expr
expr = lambda / cond (assignop expr)?
assignop = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>'? '='
lambda = (ident / <lparams> / <params>) '->' (<stmts> / expr)
lparams = (ident (',' ident)*)?
cond = bin ('?' cond2 ':' cond2)?
cond2 = lambda / cond
bin = unary (binop unary / 'instanceof' (pattern / 'final'? type))*
binop = '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>'? '>'? '='? / '+' / '-' / '*' / '/' / '%'
unary = ('+' / '-' / '++' / '--' / '!' / '~') unary / <castp> (prim unary / unary) / <castt> (lambda / !('+' / '-') unary) / post
castp = prim
castt = type ('&' type)*
post = primary suffix* ('++' / '--')?
suffix = '.' (targs? ident <args>? / 'new' creator / 'this' / 'super' <args>? / 'class') / <index> / '::' targs? (ident / 'new')
primary = 'new' creator / 'switch' <paren> <cases> / STR / NUM / 'true' / 'false' / 'null' / 'this' <args>? / 'super' (<args> / '.' targs? ident <args>? / '::' ident) / (prim / 'void') dims ('.' 'class' / '::' 'new') / cname <empty>* '::' targs? (ident / 'new') / cname <empty>+ '.' 'class' / ident <args>? / <paren>
creator = annots targs? (prim / cname) (<args> <cbody>? / (annots <index>)+ dims / (annots <empty>)+ <arrinit>)
"""


@cache
def java() -> Grammar:
    brackets = {"(": ["paren", "args", "params", "lparams", "castp", "castt", "forhead", "catchp", "resources", "annargs", "recpat"], "[": ["empty", "index"], "{": ["stmts", "cbody", "cases", "arrinit", "anninit", "ebody"]}
    return Grammar(_JAVA, brackets, {"stmts", "cbody"}, set(_JAVA_HARD))


_GO_HARD = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()


def _go() -> str:
    def expressions(x: str) -> str:
        lit = "" if x else "/ <lit>"
        return f"""
exprs{x} = expr{x} (',' expr{x})*
expr{x} = unary{x} (binop unary{x})*
unary{x} = ('+' / '-' / '!' / '^' / '*' / '&' / '<-') unary{x} / post{x}
post{x} = primary{x} ('.' (ID / <assertion>) / <args> '...'? / <index> {lit})*
primary{x} = NUM / STR / 'func' <params> result? <stmts> / {"" if x else "arrtype <lit> / 'map' <index> type <lit> / 'struct' <fields> <lit> /"} <paren> / conv / {"arrtype <lit> / 'map' <index> type <lit> /" if x else ""} ID
simple{x} = exprs{x} ('++' / '--' / (':=' / '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') exprs{x} / '<-' expr{x})?
"""

    return f"""
module = 'package' ID eos (imports / ';')* (top / ';')*
imports = 'import' (importspec / <importlist>) eos
importspec = ('.' / ID)? STR
importlist = (importspec (';' / NL) / ';')*
eos = ';' / NL
top = (func / decl) eos
func = 'func' <params>? ID <targlist>? <params> result? <stmts>?
result = <params> / type
decl = 'var' (varspec / <varlist>) / 'const' (varspec / <varlist>) / 'type' (typespec / <typelist>)
varspec = ID (',' ID)* type? ('=' exprs)?
varlist = (varspec (';' / NL) / ';')*
typespec = ID <targlist>? '='? type
typelist = (typespec (';' / NL) / ';')*
targlist = tpar (',' tpar)* ','?
tpar = ID (',' ID)* constraint
constraint = '~'? type ('|' '~'? type)*
type = '*' type / arrtype / 'map' <mapkey> type / 'chan' '<-'? type / '<-' 'chan' type / 'func' <params> result? / 'struct' <fields> / 'interface' <imeths> / <ptype> / qname <typeargs>?
ptype = type
qname = ID ('.' ID)?
mapkey = type
typeargs = type (',' type)* ','?
arrtype = <arrlen> type
arrlen = EOF / '...' / expr
params = (param (',' param)* ','?)?
param = ID '...'? type / '...'? type
fields = (field STR? (';' / NL) / ';')*
field = ID (',' ID)* type / '*'? qname <typeargs>?
imeths = (imeth (';' / NL) / ';')*
imeth = ID <params> result? / constraint
stmts = (stmt eos / ';')*
stmt = <stmts> / 'if' head <stmts> ('else' ('if' head <stmts> / <stmts>) / elseif)* / 'for' forhead? <stmts> / 'switch' (simplex? ';')? (ID ':=' exprx / exprx)? <cases> / 'select' <cases> / 'return' exprs? / 'break' (!NL ID)? / 'continue' (!NL ID)? / 'goto' ID / 'fallthrough' / ('go' / 'defer') expr / decl / ID ':' stmt? / simple
elseif = 'else' 'if' head <stmts>
head = (simplex? ';')? simplex
forhead = (exprsx (':=' / '='))? 'range' exprx / simplex? ';' exprx? ';' simplex? / exprx
cases = (('case' (simplec / typelistc) / 'default') ':' (stmt eos / ';' / !('case' / 'default') stmt)*)*
simplec = simple
typelistc = type (',' type)*
conv = arrtype <args> / ('map' <index> type / 'chan' type / 'interface' <imeths> / '*' type) <args>? / 'struct' <fields>
assertion = 'type' / type
paren = expr / type
args = (arg (',' arg)* '...'? ','?)?
arg = expr '...'? / type
index = expr? ':' expr? (':' expr)? / idx (',' idx)* ','?
idx = expr / type
lit = (elem (',' elem)* ','?)?
elem = (expr / <lit>) (':' (expr / <lit>))?
binop = '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '<<' / '>>' / '&^' / '&'
{expressions("")}{expressions("x")}"""


@cache
def go() -> Grammar:
    brackets = {"(": ["paren", "args", "params", "importlist", "varlist", "typelist", "ptype", "assertion"], "[": ["index", "arrlen", "mapkey", "typeargs", "targlist"], "{": ["stmts", "lit", "cases", "fields", "imeths"]}
    return Grammar(_go(), brackets, {"stmts", "fields"}, set(_GO_HARD), folded="[")


_LUA_HARD = "and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split()
_LUA = """
block = (stmt / ';')* ('return' exprs? ';'?)?
module = block
stmt = 'local' 'FUNCTION' / 'local' name attr (',' name attr)* ('=' exprs)? / 'FUNCTION' / 'IF' / 'while' expr 'DO' / 'for' (name '=' expr ',' expr (',' expr)? / name (',' name)* 'in' exprs) 'DO' / 'DO' / 'REPEAT' expr / 'break' / 'goto' name / '::' name '::' / assign / call
name = ID
attr = ('<' ID '>')?
assign = post (',' post)* '=' exprs
call = (ID / <paren>) (('.' ID / <index>)* (':' ID)? (<args> / <table> / STR))+
exprs = expr (',' expr)*
expr = unary (binop unary)*
binop = 'or' / 'and' / '<=' / '>=' / '<' / '>' / '~=' / '==' / '|' / '~' / '&' / '<<' / '>>' / '..' / '+' / '-' / '*' / '//' / '/' / '%' / '^'
unary = ('not' / '#' / '-' / '~') unary / simple
simple = 'nil' / 'true' / 'false' / NUM / '...' / 'LAMBDA' / <table> / post / STR
post = (ID / <paren>) suffix*
suffix = '.' ID / <index> / ':' ID (<args> / <table> / STR) / <args> / <table> / STR
paren = expr
args = exprs?
params = ((ID (',' ID)* (',' '...')?) / '...')?
table = (field ((',' / ';') field)* (',' / ';')?)?
field = <index> '=' expr / ID '=' expr / expr
index = expr
fname = ID ('.' ID)* (':' ID)? <params>
lname = <params>
"""


@cache
def lua() -> Grammar:
    return Grammar(_LUA, {"(": ["paren", "args", "params"], "[": ["index"], "{": ["table"]}, {"block", "module"}, set(_LUA_HARD))


_PY_HARD = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
_PY = """
ident = ID / 'match' / 'case' / 'type' / '_'
simple = small (';' small)* ';'?
small = 'pass' / 'break' / 'continue' / 'return' stars? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') ident (',' ident)* / 'del' stars / 'assert' expr (',' expr)? / 'import' dotted ('as' ident)? (',' dotted ('as' ident)?)* / 'from' ('.' / '...')* dotted? 'import' ('*' / <implist> / implist) / 'type' ident <tparams>? '=' expr &EOS / stars (augop (yield / stars) / ':' expr ('=' (yield / stars))? / ('=' (yield / stars))*) / yield ('=' yield)*
EOS = EOF / ';'
implist = ident ('as' ident)? (',' ident ('as' ident)?)* ','?
dotted = ident ('.' ident)*
augop = '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
stars = star (',' star)* ','?
star = '*' bor / named
yield = 'yield' ('from' expr / stars)?
named = ident ':=' expr / expr
expr = lambda / or ('if' or 'else' expr)?
lambda = 'lambda' lparams ':' expr
lparams = (lparam (',' lparam)* ','?)?
lparam = '*' ident? / '**' ident / '/' / ident ('=' expr)?
or = and ('or' and)*
and = not ('and' not)*
not = 'not' not / cmp
cmp = bor (cmpop bor)*
cmpop = '==' / '!=' / '<=' / '>=' / '<' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
bor = unary (binop unary)*
binop = '|' / '^' / '&' / '<<' / '>>' / '+' / '-' / '*' / '/' / '//' / '%' / '@'
unary = ('+' / '-' / '~') unary / power
power = 'await'? primary ('**' unary)?
primary = atom ('.' ident / <args> / <subs>)*
atom = STR+ / NUM / ident / 'None' / 'True' / 'False' / '...' / <tuple> / <list> / <dict>
tuple = (yield / star comp / stars)?
list = (star comp / stars)?
dict = ('**' bor / expr ':' expr) (comp / (',' ('**' bor / expr ':' expr))* ','?) / star comp / stars / EOF
comp = ('async'? 'for' targets 'in' or ('if' nocond)*)+
nocond = lambda / named2
named2 = ident ':=' or / or
targets = target (',' target)* ','?
target = '*'? bor
args = (arg (',' arg)* ','?)?
arg = '*' expr / '**' expr / ident '=' expr / named comp? 
subs = sub (',' sub)* ','?
sub = expr? ':' expr? (':' expr?)? / '*' bor / named
params = (param (',' param)* ','?)?
param = '*' ident (':' starann)? / '*' / '**' ident (':' expr)? / '/' / ident (':' expr)? ('=' expr)?
starann = '*'? expr
tparams = tparam (',' tparam)* ','?
tparam = ('*' / '**')? ident (':' expr)? ('=' expr)?
tail = ':' simple?
h_if = 'if' named tail
h_elif = 'elif' named tail
h_else = 'else' tail
h_try = 'try' tail
h_except = 'except' '*'? (expr (',' expr)* ('as' ident)?)? tail
h_finally = 'finally' tail
h_while = 'while' named tail
h_for = 'async'? 'for' targets 'in' stars tail
h_def = 'async'? 'def' ident <tparams>? <params> ('->' expr)? tail
h_class = 'class' ident <tparams>? <args>? tail
h_with = 'async'? 'with' (<withs> tail / withs tail)
withs = with (',' with)* ','?
with = expr ('as' target)?
h_match = 'match' stars ':'
h_case = 'case' patterns ('if' named)? tail
patterns = spat (',' spat)* ','?
spat = '*' ident / pat
pat = orpat ('as' ident)?
orpat = closed ('|' closed)*
closed = <patterns> / <pats> / <pmap> / '-'? NUM (('+' / '-') NUM)? / STR+ / 'None' / 'True' / 'False' / ident ('.' ident)* <pargs>?
pats = patterns?
pargs = ((ident '=' pat / pat) (',' (ident '=' pat / pat))* ','?)?
pmap = (('**' ident / pkey ':' pat) (',' ('**' ident / pkey ':' pat))* ','?)?
pkey = '-'? NUM / STR+ / 'None' / 'True' / 'False' / ident ('.' ident)*
decorator = '@' named
field = yield / stars
block = bstmt+
module = bstmt*
bstmt = 'S' / ('I' body / 'i') ('L' body / 'l')* ('E' body / 'e')? / ('W' / 'R') body ('E' body / 'e')? / ('w' / 'r') ('E' body / 'e')? / ('T' body / 't') (('X' body / 'x')+ ('E' body / 'e')? ('F' body / 'f')? / 'F' body / 'f') / 'A'* ('D' body / 'd' / 'C' body / 'c') / 'H' body / 'h' / 'M' <casebody>
body = <block>
casebody = ('K' body / 'k')+
"""


@cache
def python() -> Grammar:
    brackets = {"(": ["tuple", "args", "params", "implist", "withs", "patterns", "pats", "pargs"], "[": ["list", "subs", "tparams", "pats"], "{": ["dict", "pmap"]}
    return Grammar(_PY, brackets, set(), set(_PY_HARD), indented=True)
