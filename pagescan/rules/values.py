"""Word lists, weights, patterns and messages the results depend on.

Patterns are written in Python ``re`` syntax; ``functions.dialect.to_java`` turns
them into the same language for the JVM.
"""

# --- URL layer -------------------------------------------------------------
SUSPICIOUS_TLDS = {
    "pro": 2, "xyz": 2, "pw": 2, "top": 2, "loan": 2, "win": 2, "bid": 2, "online": 2,
    "tk": 3, "ga": 3, "gq": 3, "ml": 3, "cf": 3,
}
SHORT_LINK_DOMAINS = ["bit.ly", "goo.gl", "tinyurl.com", "t.co", "ow.ly", "is.gd", "adf.ly"]
TRUSTED_CDN = [
    "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "code.jquery.com",
    "ajax.googleapis.com", "fonts.googleapis.com", "fonts.gstatic.com",
    "unpkg.com", "cdn.staticfile.org", "stackpath.bootstrapcdn.com",
    "cdn.bootcdn.net", "hm.baidu.com", "www.googletagmanager.com",
]
STANDARD_PORTS = [80, 443, 8080, 8443]
QUERY_WORDS = ["redirect", "proxy", "referer", "origin", "callback"]
BAIT_WORDS = ["login", "signin", "account", "verify", "secure", "update", "confirm"]
NEUTRAL_DOMAIN_WORDS = ["sample", "example", "test", "demo"]

# The four URL shapes, in matching order.  The second is "a slash not followed by a
# slash, then path characters".
URL_HTTP = r"https?://[^\s<>\"']+"
URL_PATH = r"/(?!/)[-\w./?%&=#]+"
URL_JAVASCRIPT = r"javascript:[^\s<>\"']+"
URL_DATA = r"data:[^;]+;base64,[^\s<>\"']+"
RANDOM_SCRIPT_NAME = r"/[a-zA-Z0-9]{8,}\.(?:js|php)$"
RANDOM_JS_NAME = r"/[a-zA-Z0-9]{8,}\.js$"

REASON_JS_PSEUDO = "JavaScript 伪协议"
REASON_DATA = "Data URI"
REASON_PORT = "非标准端口"
REASON_TLD = "高风险域名后缀 ."
REASON_SHORT = "短链接服务"
REASON_RANDOM_PATH = "可疑随机路径"
REASON_EXTERNAL_LINK = "外部链接"
REASON_RANDOM_DOMAIN = "可能为随机生成域名"
REASON_QUERY = "可疑查询参数: "
REASON_CSS_JS = "JavaScript 协议"
REASON_CSS_EXTERNAL = "外部 CSS 资源"
REASON_CSS_IMPORT = "外部 CSS 导入"
REASON_JS_EXTERNAL = "外部 JS URL"
REASON_JS_TLD = "可疑 TLD ."
REASON_JS_RANDOM = "长随机文件名"
REASON_COMMENT_LINK = "链接位于 HTML 注释中"
REASON_META = "通过 Meta 标签重定向"

# --- HTML text rules: name, pattern, severity, description, literals one of which must occur --
HTML_PATTERNS = [
    ("suspicious_attributes", r"\bon\w+\s*=\s*[\"']?javascript:", 3, "可疑的事件属性", ["javascript:"]),
    ("eval_inline", r"\beval\s*\(", 4, "内联 eval 函数", ["eval"]),
    ("document_write", r"\bdocument\.write\s*\(", 3, "document.write 调用", ["document.write"]),
    ("base64_decode", r"\batob\s*\(|\bfromCharCode\s*\(", 2, "Base64 解码操作", ["atob", "fromcharcode"]),
    ("data_uri", r"data:[^;]+;base64,", 2, "Data URI", [";base64,"]),
    ("remote_iframe", r"<iframe[^>]+src=[\"']?https?://", 3, "远程 iframe", ["<iframe"]),
    ("obfuscated_attributes",
     r"\b(data-|on)[a-z0-9_-]+\s*=\s*[\"']?[^\"']*(\\\\x[0-9a-f]{2}|\\\\u[0-9a-f]{4})",
     3, "混淆的属性", [r"\\x", r"\\u"]),
]
HTML_HIDDEN = (r"<(div|span|p|section|article)[^>]+style=[\"'][^\"']*"
               r"(display\s*:\s*none|visibility\s*:\s*hidden)")
HTML_HIDDEN_DESCRIPTION = "CSS 隐藏的块元素"
HTML_COMMENT = r"<!--(.*?)-->"
HTML_COMMENT_RULES = [
    ("hidden_content", r"(?:password|secret|hidden|private|admin)", "i", 3, "包含敏感信息的注释"),
    ("encoded_content", r"(?:base64|hex|escape|decodeURI)", "i", 3, "包含编码内容的注释"),
    # Text between comment marks holds no comment end, so no look-ahead is needed here.
    ("conditional_comments", r"<!--\[.*\]>", "s", 1, "条件注释"),
]
HTML_COMMENT_LINK = r"href=[\"'](https?://[^\"']+)"
HTML_META = (r"<meta[^>]+http-equiv=[\"']?(refresh|redirect)[\"']?[^>]+content=[\"']?"
             r"[^\"']*url=(\S+)[\"']?")

# --- DOM rules ---------------------------------------------------------------
DOM_INLINE_CALLS = [r"\beval\s*\(", r"\bdocument\.write\s*\(", r"\bfromCharCode\s*\("]
DOM_OFFSCREEN = r"(?:left|top)\s*:\s*-\d{3,}px"
DOM_ZERO_FONT = r"font-size\s*:\s*0"
DOM_SENSITIVE_NAMES = ["token", "csrf", "auth", "password", "secret", "key", "credential"]
DOM_HIDING_CLASSES = ["hidden", "hide", "invisible", "visually-hidden", "sr-only", "d-none"]
DOM_LINK_REASONS = {"css": "CSS 隐藏", "opacity": "透明链接", "font": "零字号",
                    "offscreen": "定位到屏幕外", "aria": "aria-hidden 属性"}
DOM_IFRAME_REASON = "外部 iframe"
DOM_IFRAME_REASON_EXTERNAL = "外部域名"
DOM_BAIT_REASON = "链接文字具有诱导性（登录/验证/账户）"
DOM_DESCRIPTIONS = {
    "external_script": "外部脚本来源", "no_sri": "外部脚本缺少 SRI 完整性校验",
    "suspicious_inline_script": "内联脚本包含高危函数", "iframe": "iframe 元素",
    "hidden_iframe": "隐藏的 iframe", "no_sandbox": "iframe 缺少 sandbox 属性",
    "hidden_link": "隐藏链接 ({})", "suspicious_link": "可疑链接",
    "form_external": "表单提交到外部 URL", "form_absolute": "表单提交到绝对 URL",
    "sensitive_hidden_field": "隐藏字段包含敏感名称: {}",
    "suspicious_hidden_value": "隐藏字段值包含可疑内容",
    "insecure_login": "HTTP 明文页面包含密码输入框",
    "styled_hidden": "通过 {} 元素的 inline style 隐藏", "zero_opacity": "{} 元素 opacity 为 0",
    "offscreen_positioned": "{} 元素被定位到屏幕外",
    "hidden_attribute": "{} 元素使用了 hidden 属性", "hiding_class": "{} 使用隐藏类名: {}",
}

# --- JavaScript rules --------------------------------------------------------
JS_HIGH_RISK = {
    "eval": 5, "Function": 4, "execScript": 5, "setTimeout": 3, "setInterval": 3,
    "innerHTML": 4, "outerHTML": 4, "XMLHttpRequest": 3, "fetch": 3, "WebSocket": 3,
    "unescape": 3, "decodeURI": 2, "decodeURIComponent": 2,
    "appendChild": 3, "insertBefore": 3, "replaceChild": 3,
}
JS_DOM_OPERATIONS = {"innerHTML": 4, "outerHTML": 4, "appendChild": 3, "insertBefore": 3,
                     "replaceChild": 3}
JS_OBFUSCATION = [
    ("hex_encoding", r"\\x[0-9a-fA-F]{2}", "十六进制编码", [r"\x"]),
    ("unicode_encoding", r"\\u[0-9a-fA-F]{4}", "Unicode 编码", [r"\u"]),
    ("string_concat", r"[\"'][^\"']*[\"']\s*\+\s*[\"'][^\"']*[\"']", "字符串拼接", ["+"]),
    # At most one match per line: tried from the first bracket of a line only (group 1 is skipped).
    ("array_join", r"(?:(?m:^)|\G)([^\[\n]*+)\[.*\]\.join\s*\(\s*[\"']", "数组操作混淆", ["].join"]),
    ("reversed_string", r"\.split\(\s*[\"']\s*\)\s*\.reverse\(\)\s*\.join", "反转字符串", [".reverse()"]),
    ("eval_concat", r"eval\s*\(\s*[a-zA-Z0-9_$\[\]]+\s*\+", "带参数拼接的 eval", ["eval"]),
]
JS_PATTERNS = [
    ("self_executing",
     r"(function\s*\(\s*\)\s*\{[^\}]*\}\s*\(\s*\))|\(([^\)]+)\)\(\)", 3, "自执行函数", ["function", ")()"]),
    ("conditional_eval", r"if\s*\([^\)]*\)\s*\{[^\}]*eval\s*\(", 4, "条件 eval 调用", ["eval"]),
    ("try_catch_eval", r"try\s*\{[^\}]*eval\s*\([^\)]*\)[^\}]*\}\s*catch", 4, "try-catch 中的 eval", ["eval"]),
    ("hidden_eval", r"[a-zA-Z_$][a-zA-Z0-9_$]*\s*=\s*[\"']eval[\"'].*;.*\[.*\]\s*\(", 5,
     "隐藏的 eval 调用", ["eval'", 'eval"']),
    ("cookie", r"document\.cookie", 3, "Cookie 操作", ["document.cookie"]),
    ("referrer", r"document\.referrer", 1, "Referrer 检查", ["document.referrer"]),
    ("user_agent", r"navigator\.userAgent", 1, "User-Agent 检查", ["navigator.userAgent"]),
]
JS_COMMENT_WORDS = ["hack", "exploit", "backdoor", "trojan", "malware", "keylogger",
                    "cracker", "steal", "inject", "redirect", "obfuscate", "phish"]
LINE_COMMENT = r"//(.+)"
BLOCK_COMMENT = r"/\*(.+?)\*/"
BASE64_RUN = r"[A-Za-z0-9+/=]{32,}"
CODE_COMMENTS = r"//[^\n]*|/\*.*?\*/"
EVIDENCE_BASE64 = "Base64-like 字符串"
EVIDENCE_ENTROPY = "熵值 %.2f"
EVIDENCE_MATCHES = "%d 处匹配"

# --- CSS rules -----------------------------------------------------------------
CSS_HIDING_VALUES = {
    "display": ["none", "list-item", "table-caption"],
    "visibility": ["hidden", "collapse"],
    "opacity": ["0", "0.0", "0.00"],
    "clip": ["rect(0, 0, 0, 0)"],
    "clip-path": ["circle(0)", "polygon(0 0)"],
    "z-index": ["-9999", "-999", "-1000"],
    "height": ["0", "0px", "0%"],
    "width": ["0", "0px", "0%"],
    "overflow": ["hidden"],
    "text-indent": ["-9999px", "-999px", "-1000px"],
    "transform": ["translateX(-9999px)", "translateY(-9999px)"],
}
CSS_ABSOLUTE = (r"\.?[#\w][^{]+\{[^}]*"
                r"(?:left|top|right|bottom)\s*:\s*-\d{3,}(?:px|em|%)")
CSS_ABSOLUTE_DIGITS = r"-(\d{3,})(?:px|em|%)$"
CSS_OFFSET = r":\s*-\d{3,}(?:px|em|%)"
CSS_SELECTORS = [
    ("attr_js", r"\[[^\]]+=[^\]]*(?:javascript:|data:)[^\]]*\]", 4, "属性选择器中的 JS/Data URL",
     ["javascript:", "data:"]),
    ("long_class", r"\.[a-zA-Z0-9_$]{15,}", 2, "异常长的类名", ["."]),
    ("long_id", r"#\w{15,}", 2, "异常长的 ID 名", ["#"]),
]
CSS_PROPERTIES = [
    ("bg_image", r"url\(\s*[\"']?(?:data:|javascript:)", "background-image", ["url("]),
    ("bg_ext", r"url\(\s*[\"']?https?://[^\)]+\)", "background-image", ["url("]),
    ("content_after", r":after\s*\{[^\}]*content\s*:\s*[\"'](?:javascript:|data:)", "content", [":after"]),
    ("content_before", r":before\s*\{[^\}]*content\s*:\s*[\"'](?:javascript:|data:)", "content", [":before"]),
]
CSS_IMPORT = r"@import\s+(?:url\(\s*[\"']?([^\"')\s]+)[\"']?\s*\)|[\"']([^\"']+)[\"'])"
CSS_COMMENT_WORDS = ["hidden", "stealth", "cloaking", "obfuscate", "invisible",
                     "seo", "spam", "backlink", "redirect", "hack", "exploit", "malware", "phish"]
CSS_LONG_NAMES = r"(?:\.|#)([a-zA-Z0-9_]{20,})"
CSS_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
EVIDENCE_IMPORTS = "%d 个 @import"
EVIDENCE_LONG_NAMES = "%d 个超长选择器"
EVIDENCE_CONTROL = "%d 个控制字符"

# --- Hiding techniques -----------------------------------------------------------
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"
WHITESPACE_RUN = r"\s{10,}"
TEXT_COLOR = r"(?<!background-)color\s*:\s*(#\w{3,6}|rgba?\([^)]+\))"
#: The same up to the opening bracket; group 2 is then the beginning of the colour.
TEXT_COLOR_HEAD = r"(?<!background-)color\s*:\s*(?:(#\w{3,6})|(rgba?\())"
BACKGROUND_COLOR = r"background-color\s*:\s*(#\w{3,6}|rgba?\([^)]+\)|\w+)"
BLACKS = ["#000", "#000000", "black", "rgb(0,0,0)", "rgba(0,0,0,1)"]
WHITES = ["#fff", "#ffffff", "white", "rgb(255,255,255)", "rgba(255,255,255,1)"]
HIDING_POSITION = (r"position\s*:\s*absolute.*?(left|top|bottom|right)\s*:\s*"
                   r"(-?\d+(?:\.\d+)?(?:px|em|%)?)")
HIDING_POSITION_TAIL = r"(?:left|top|bottom|right)\s*:\s*-?\d+(?:\.\d+)?(?:px|em|%)?"
HIDING_FONT = r"font-size\s*:\s*(0|0\.\d+)"
HIDING_INDENT = r"text-indent\s*:\s*(-\d+(?:\.\d+)?(?:px|em|%))"
HIDING_OPACITY = r"opacity\s*:\s*(0|0\.0+)(?![.\d])"
HIDING_VISIBILITY = r"visibility\s*:\s*hidden"
HIDING_DISPLAY = r"display\s*:\s*none"
HIDING_NESTED = r"<(div|span|p|a)[^>]*>\s*<(div|span|p|a)[^>]*>\s*<(div|span|p|a)[^>]*>"
NUMERIC_ENTITY = r"&#(\d+);|&#x([0-9a-f]+);"
EVIDENCE_ZERO_WIDTH = "%d 个零宽字符"
EVIDENCE_WHITESPACE = "空白堆积 (%d 个)"
EVIDENCE_COLOR = ("文字 ", " ≈ 背景 ")
EVIDENCE_NESTED = "多层嵌套"
EVIDENCE_ENTITIES = "%d 个 HTML 实体"
TECHNIQUES = {
    "zero_width": "零宽字符隐藏", "whitespace": "空白字符堆积", "color_match": "颜色隐藏",
    "absolute_pos": "绝对定位隐藏", "font_size": "字体大小隐藏", "text_indent": "文本缩进隐藏",
    "opacity": "透明度隐藏", "visibility": "可见性隐藏", "display_none": "显示隐藏",
    "nested": "多层嵌套隐藏", "entities": "HTML 实体编码隐藏",
}

# --- Keywords, files, report ---------------------------------------------------
KEYWORD_CATEGORIES = {"gambling": "博彩", "porn": "色情", "malware": "恶意软件",
                      "phishing": "钓鱼", "other": "其他"}
HTML_EXTENSIONS = [".html", ".htm", ".shtml", ".xhtml", ".php", ".asp", ".aspx", ".jsp"]
CSS_EXTENSIONS = [".css", ".less", ".scss", ".sass"]
JS_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
INTERNAL_HOST = (r"^(127\.0\.0\.1|localhost|10\.\d+\.\d+\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+"
                 r"|192\.168\.\d+\.\d+)$")
ERROR_UNREADABLE = "无法读取: "
ERROR_FETCH = "获取失败: "
CSV_COLUMNS = ["序号", "规则ID", "类别", "严重程度", "来源类型", "来源", "证据", "上下文"]
SECTIONS = {"suspicious_url": "可疑链接", "keyword_match": "关键字匹配", "hidden_element": "隐藏元素",
            "js_issue": "JS 问题", "css_issue": "CSS 问题", "other": "其他发现"}
VERDICTS = {"critical": "高风险", "high": "中高风险", "low": "低风险", "clean": "未发现问题"}
RENDERED_LINK = "动态链接: "
RENDERED_HIDDEN_LINK = "隐藏元素中的链接: "
RENDERED_REASON = ("隐藏在 ", " 元素中")
