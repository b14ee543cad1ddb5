"""Patterns, word lists and tables whose results depend on their exact values.

Java syntax. Word boundaries are ASCII, written out as look-arounds, since Java's own treat
accented letters as word characters.
"""

from __future__ import annotations

B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: One word character; ``first`` of a pattern is read before its boundary, so that most places fail at one comparison.
W = "[A-Za-z0-9_]"
first = lambda c: f"{c}(?<!{W}{c})"  # noqa: E731  the same as B + c, for one character or class c
#: A boundary on either side, for patterns that may begin or end with another character.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Fixed values from here on.

#: Volatile parts of a lower-case text, blanked in this order before it is fingerprinted.
VOLATILE = [
    rf"{first(r'\d')}\d{{3}}-\d{{2}}-\d{{2}}[t ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?z?",
    rf"{first(r'\d')}\d:\d{{2}}:\d{{2}}(?:[.,]\d+)?{E}",
    rf"{first('[0-9a-f]')}[0-9a-f]{{7}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}{E}",
    rf"{first('0')}x[0-9a-f]+{E}",
    rf"{first('a')}t line \d+",
    rf"{first('r')}eq(?:uest)?[ _-]?id[:=] ?[^\s,]+",
    rf"{first('t')}emp(?:orary)?[ _-]?(?:file|path)[:=] ?[^\s,]+",
]
MEMORY_ID = rf"{first('[RDTBCS]')}(?:(?<=R)EQ|(?<=D)EC|(?<=T)ECH|(?<=B)ENCH|(?<=T)ASK|(?<=B)LOCK|(?<=C)MP|(?<=C)ONFLICT|(?<=S)TATE)-\d+{E}"
PATH_WIN = r"[A-Za-z]:\\[^\s\"'`|<>]+"
PATH_UNIX = r"/[A-Za-z0-9_.@-]++(?:/[A-Za-z0-9_.@-]++)+"
PATH_REL = r"\.(?<![A-Za-z0-9_/]\.)\.?/[A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)*"
URL = rf"{first('h')}ttps?://[^\s\"'`<>]+"
_NUMBER = rf"(?:{first('v')}\d+|{first(r'\d')}\d*)"
VERSION = rf"{_NUMBER}\.\d+(?:\.\d+)*(?:-[0-9A-Za-z.-]+)?{EDGE}"
#: A $ is no word character, so there a boundary stands after one.
SYMBOL = rf"(?:{first('[A-Za-z_]')}|\$(?<={W}\$))[A-Za-z0-9_$]{{2,}}(?:[.-][A-Za-z0-9_$]+)*{EDGE}"
ERROR_CODE = rf"{first('[A-Z]')}(?:[A-Z0-9]*+(?:_[A-Z0-9]++)+{E}|[A-Z0-9]{{4,}}{E})"
STATUS_CODE = rf"{first('[45]')}\d{{2}}{E}"
PORT = rf":\d{{2,5}}{E}"
IP = rf"{first(r'\d')}\d{{0,2}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{E}"
MODEL_NAME = rf"{first('[a-z]')}[a-z0-9]*+(?:-[a-z0-9]++)+{E}"
COMMAND = r"`([^`\n]{2,160})`"
NUMBER_UNIT = rf"\d+(?:\.\d+)?\s?(?:ms|s|min|h|hours?|toks?/s|tokens?|chars?|characters?|lines?|files?|tests?|cases?|gb|mb|kb|percent|%|k{E}|m{E})"
NUMBER_UNIT_ANY_CASE = r"(?i)" + NUMBER_UNIT
HASH = rf"{first('[0-9a-f]')}[0-9a-f]{{7,39}}{E}"
EXIT_CODE = rf"(?i){first('e')}xit\s*code\s*:?\s*\d+"

#: Exact facts, in order; the last number is the group taken.
FACTS = [(NUMBER_UNIT, 0), (PATH_WIN, 0), (PATH_UNIX, 0), (PATH_REL, 0), (URL, 0), (VERSION, 0), (HASH, 0), (ERROR_CODE, 0), (STATUS_CODE, 0), (PORT, 0), (IP, 0), (MEMORY_ID, 0), (COMMAND, 1), (EXIT_CODE, 0)]

#: Exact atoms of a normalised text, by pattern and group.
ATOMS = [
    (rf"{first('h')}ttps?://[^\s\"'`),;]+", 0),
    (r"[a-z]:\\(?:[^\\\s/]+\\)*[^\\\s/]+", 0),
    (r"(?:^|[\s\"'`=:(<])((?:\.\.?/|/)[^\s\"'`),;]+)", 1),
    (rf"{first('[0-9a-f]')}[0-9a-f]{{15,39}}{E}", 0),
    (rf"{first(r'\d')}\d*(?:\.\d+)?\s*(?:tok/s|tokens?/s|ms|us|gb|mb|tb|kb|ghz|mhz|hz|watts?|k|%){EDGE}", 0),
    (rf"{_NUMBER}(?:\.\d+)+(?:[-.][a-z0-9]+)*{E}", 0),
    (rf"{first('[a-z]')}[a-z]*+\d+(?:-[a-z0-9]+)*{E}", 0),
    (rf"{first('[a-z]')}[a-z]*+-\d+[a-z]*(?:-\d+[a-z]*)*{E}", 0),
    (rf"{first(r'\d')}\d*(?:\.\d+)?{E}", 0),
    (rf"{first('[ec]')}(?:(?<=e)(?:rror|rr|xit\s*code|rrno)|(?<=c)ode)[:\s=#-]*\d{{1,6}}{E}", 0),
    (r"`[^`\n]{3,}`", 0),
    (rf"(?=[npgdkcmbs]){B}(?:npm|pnpm|node|npx|git|docker|kubectl|cargo|make|pytest|python3?|go|bash|sh)\s+[a-z@][^\s\"'`)]+", 0),
]

#: What stands in every match of an atom's pattern, by its place; those from 4 to 9 each hold a digit.
ATOM_SIGNS = {0: "://", 1: ":\\", 2: "/", 10: "`"}
ATOMS_OF_DIGITS = (4, 10)

KEYWORD_STOP = "with that this have from will your they them been were into when which their there would could should about after before while then than because where every some more most other such only also very just like over under here what how why who and the for not are was you our its out all can did get had has let may new now one see use used using via per etc www http https true false null undefined string number object return function const var import export async await type interface class error value values name names kind data info"
EVIDENCE_STOP = "the and for with from this that are was were not but all any can had has have one its our you your will would then than when what which who into over under about after before because while such each some more most other these those there here now yes use used using via per etc they them their him her his she he it be to in on at by or if so no do did as of an am is were may"
LEDGER_STOP = "the and for are was were with from that this have has had will would can could should not but all any each its into over under about after before between during without within then than them they their there these those very just also only both some such more most other others new old one two see says said via per etc use used using make made makes way ways part parts case cases entry entries file files test tests code data value values config default defaults current state note notes line lines text word words"

#: What a model's error says when a request was too long.
OVERFLOW = rf"(?i)context[\s_-](?:length|window)[\s_-](?:exceed(?:ed|s)?|overflow(?:ed)?|limit[\s_-]exceeded)|maximum(?:\s+(?:allowed|supported))?\s+context\s+(?:length|window)|(?:input|prompt|request|messages?){E}.{{0,60}}{B}(?:exceed(?:ed|s)?|too\s+(?:large|long)){E}.{{0,60}}{B}context{E}"
#: Injected text that carries no marker of its source.
FRAMING = rf"(?i)^<(system-reminder|context|runtime-context)>|^current runtime context{E}"

GREETING = r"(?i)^(你好|您好|hi|hello|hey|ok|okay|好的|嗯|嗯嗯|收到|明白|谢谢|thx|thanks|thank you|继续|继续吧|go|开始|开始吧|好的。|好|是|对|yes|no|嗯，|可以|行|done|完成|完成。|好的，继续|请继续|go ahead|proceed|continue|continue\.|ok\.?)"

CONSTRAINT = r"(?i)必须|不能|不要|禁止|务必|只能|不允许|不得|保持|沿用|保留|只(能|用|可以)|do\s+not|don'?t|never|always|must\s+not|must\s+use|only\s+(use|keep)|keep\s+it\s|exactly|别改|不要改"
CORRECTION = r"(?i)不对|错了|纠正|改一下|实际上是|应该是|应该用|改成|换成|no,\s|that'?s\s+not|wrong,|wrong\.|actually,|in\s+fact,|you\s+(said|assumed)|我(说|强调|要求)过"
GOAL = r"(?i)目标[:：]?|goal[:：]?|objective|本轮(要|目标)|接下来(要|需要|做)|执行.*方案|现在(要|开始|继续)|任务[:：]?|task[:：]?|需求[:：]?|继续修复|继续执行"
SAFETY = r"(?i)安全|兼容|不能破坏|不能(再)?丢|不得丢失|safety|compat|backward-?compat|must\s+not\s+break|cannot\s+lose"
DECISION = r"(?i)决定|决策|采用|选用|弃用|架构(决定|选择|决策)|decided|decision:|we\s+will|going\s+to\s+(use|adopt|drop)|选择使用"
ROOT_CAUSE = r"(?i)根因|根本原因|root\s+cause|原因是|问题出在|caused\s+by|the\s+cause\s+is|导致.*的(原因|根源)"
VERIFIED = rf"(?i)验证(通过|成功)|已验证|verified|passed{E}|全部通过|all\s+(tests\s+)?pass|exit\s*code\s*:?\s*0{E}|测试通过|基准(结果|数据)|benchmark"
KEY_FIX = rf"(?i)修复(了|成功)|已修复|fixed{E}|patch(?:es)?\s*[:：]|hotfix|补丁|hot\s*fix"
RESTATED = r"(?i)目标|goal|objective|task[:：]"
EXIT_OK = r"(?i)exit\s*code\s*:?\s*0|passed|通过"
CONFIG_PATH = r"(?i)(?:^|[\s'\"`=(\[{\\:])(?:[A-Za-z]:\\[A-Za-z0-9_./\\-]*\.(?:ya?ml|toml|json)|[A-Za-z0-9_./\\-]*\.(?:ya?ml|toml|json)|package\.json|settings\.[A-Za-z0-9_.]+|cordis[A-Za-z0-9_.-]*\.yml|\.env[A-Za-z0-9_.-]*|config[A-Za-z0-9_./-]*)"

BUILD = r"(?i)error|warning|fail|build|compile|bundling|vite|webpack|tsc|esbuild|pnpm|npm"
TEST = rf"(?i){B}test(?:s|ing)?{E}|vitest|jest|mocha|pytest|node --test|passing|failing|{B}pass{E}|{B}fail{E}"
GIT_STATUS = rf"{B}git\s+status{E}|{B}On branch{E}|{B}nothing to commit{E}|{B}Changes to be committed{E}"
GIT_DIFF = rf"{B}git\s+diff{E}|{B}diff --git{E}|{B}index [0-9a-f]+\.\."
BENCH = rf"(?i)benchmark|{B}bench{E}|基准|耗时|throughput|latency|p95|p50|tokens/s|tok/s"
TOOL_TYPES = {"read": "file-read", "read_file": "file-read", "cat": "file-read", "glob": "dir-listing", "ls": "dir-listing", "grep": "search-result", "find": "search-result", "search": "search-result", "web_search": "web-search", "search_web": "web-search", "web_fetch": "web-search"}

INTENT_FULL = r"tell\s+me\s+(everything|the\s+whole|all)|full\s+(state|context|picture)|整体(回顾|状态|情况)|项目(全貌|总览|全部)|handoff|hand-off|交接|重启(后)?(继续|状态)|after\s+(the\s+)?(restart|compaction)|summarize\s+(the\s+)?(project|ledger)|给我(项目|全部|整体)"
INTENT_GOAL = r"(?:项目|project|本(?:项|次)工作|任务)(?:的)?\s*(?:目标|目的|需求|要求|范围|要做什么|要完成什么)|(?:目标|目的|需求|要求|范围)\s*[:：]|(?:目标是|任务是|必须(?:支持|实现|保留|完成)|需要(?:支持|实现|完成)|要实现|要完成|we\s+need\s+to|the\s+goal\s+is|requirements?\s*[:：]|scope\s*[:：])"
INTENT_WORK = r"(?:项目|project|仓库|repo|代码库|worktree).*(?:优化|修复|实现|继续|修改|检查|评估|开发|部署|测试|完成|维护|改进|fix|implement|review|debug|test|continue)|(?:优化|修复|实现|继续|修改|检查|评估|开发|部署|测试|完成|维护|改进|fix|implement|review|debug|test|continue).*(?:项目|project|仓库|repo|代码库|worktree)"
INTENT_DECIDE = r"decide|decided|decision|plan|design|architect|refactor|rewrite|决定|决策|改成|换成|切换|替换|弃用|选用|重写|迁移|migrat|重构|方案|架构|选型|规划|tradeoff|trade-off|取舍"
INTENT_STATUS = r"where\s+(are|is)\s+(we|it|this)|current\s+(state|status)|status\s+update|现在(什么)?(状态|进展|进度)|当前(?:项目|工程|仓库)?(状态|进展|进度)|(?:项目|工程|仓库).*(状态|进展|进度)|什么(进展|进度)"
INTENT_QUESTION = rf"(^|[\s?？])\s*(what|why|how|which|when|where){E}|怎么|为什么|如何|哪个|何时|是否|能不能|可不可以|是什么|有哪些"
INTENT_CHAT = r"^(hi|hiya|hello|hey|yo|thanks|thank\s+you|thank\s+u|thx|ty|谢谢|多谢|辛苦|好的|好滴|嗯+|ok+|okay|可以|没问题|收到|明白|👍|silly|joke|笑话|无聊)\.?[!！。.]*\z"

#: Content types: intrinsic value, decay in turns (None: never), reconstructibility.
CONTENT_TYPES = {
    "hard-constraint": (1.0, None, 0.0),
    "active-decision": (0.98, 40, 0.1),
    "blocker": (0.95, 40, 0.2),
    "goal": (0.95, 40, 0.0),
    "benchmark": (0.85, 80, 0.35),
    "root-cause": (0.82, 40, 0.2),
    "key-fix": (0.8, 40, 0.2),
    "file-relation": (0.75, 16, 0.95),
    "assistant-reasoning": (0.55, 16, 0.3),
    "search-result": (0.3, 5, 0.9),
    "file-read": (0.3, 8, 0.95),
    "git-status": (0.3, 3, 1.0),
    "git-diff": (0.3, 3, 0.95),
    "dir-listing": (0.3, 3, 1.0),
    "web-search": (0.3, 5, 0.7),
    "test-log": (0.35, 10, 0.85),
    "build-log": (0.2, 3, 0.9),
    "tool-log": (0.15, 3, 0.9),
    "repeated-tool-output": (0.1, 3, 0.9),
    "user-request": (0.35, 24, 0.0),
    "greeting": (0.02, 3, 1.0),
    "checkpoint": (0.9, 40, 0.2),
    "injected": (0.15, 8, 1.0),
}
TIERS = ["PINNED", "HOT", "WARM", "COLD", "TRASH"]
ZONE_TIERS = {"Z0": [], "Z1": [], "Z2": ["TRASH", "COLD"], "Z3": ["TRASH", "COLD", "WARM"], "Z4": ["TRASH", "COLD", "WARM"], "Z5": ["TRASH", "COLD", "WARM", "HOT"]}
CLASS_BUDGETS = {"C0": 0, "C1": 0, "C2": 768, "C3": 2048, "C4": 4096, "C5": 8192}
