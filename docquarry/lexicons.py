"""Word lists and tables that results depend on. All are fixed values, in the order that the results need; every
operator takes them as a parameter, with these as defaults."""

from __future__ import annotations

# ---- Fixed values: HTML main text ----
DROP_TAGS = ("script", "style", "noscript", "svg", "canvas", "iframe", "nav", "header", "footer", "aside", "form", "button")
DROP_ATTR_WORDS = (
    "menu", "nav", "navbar", "header", "footer", "breadcrumb", "breadcrumbs", "sidebar", "aside", "search", "share", "social", "cookie",
    "captcha", "feedback", "subscribe", "pagination", "toolbar", "popup", "modal", "blind", "visually", "cabinet", "login", "lk",
)
CONTENT_ATTR_WORDS = ("content", "main", "article", "document", "doc", "text", "body", "news-detail", "publication", "page-content", "detail", "material")
LEGAL_MARKERS = (
    "статья", "глава", "раздел", "пункт", "часть", "абзац", "постановление", "приказ", "федеральный закон", "закон", "кодекс", "гост",
    "свод правил", "технический регламент", "правила", "положение", "утвердить", "внести изменения", "российской федерации", "министерство", "верховный суд",
)
BOILERPLATE_LINES = (
    "найти", "меню", "поиск", "контакты", "новости", "деятельность", "документы", "правовая информация", "обращения граждан", "главная",
    "главная страница", "карта сайта", "обратная связь", "поделиться", "расширенный поиск", "все разделы сайта", "перейти к контенту",
    "загрузка...", "прервать", "рус", "eng", "ru", "en", "русский", "english", "версия для слабовидящих", "version for visually impaired",
    "личный кабинет", "вход", "пресс-центр", "официальный сайт", "наверх", "подача обращений", "электронная справочная",
)
#: Starts of short boilerplate lines; a word ends there.
BOILERPLATE_STARTS = ("открыть панель", "поделиться", "версия для слабовидящих", "version for visually impaired", "личный кабинет", "выполняется запрос")
BOILERPLATE_PATTERNS = (r"^помним и гордимся победой!?$", r"^\d{1,2}\s*:\s*\d{1,2}(\s*:\s*\d{1,2})?$", r"^99\s*:\s*99")
CANDIDATE_SELECTORS = (
    "main", "article", "[role=main]", ".content", ".main", ".article", ".document", ".doc", ".text", ".page-content", ".news-detail",
    ".detail", ".material", "#content", "#main", "#article", "#document", "#docContent",
)
CANDIDATE_TAGS = ("div", "section", "article", "td", "body")
#: First words of a document's first line.
START_WORDS = (
    "российская федерация", "конституция", "кодекс", "федеральный конституционный закон", "федеральный закон", "закон", "постановление",
    "приказ", "распоряжение", "определение", "решение", "об утверждении", "гражданский процессуальный кодекс",
)

# ---- Fixed values: decoding ----
SHELL_MARKERS = ("Текст документа:", "Загрузка документа", "Сравнение редакций", "Выберите предпочитаемый стиль", "Проверка ЭЦП", "Вниз по тексту", "Вверх по тексту")
CHARSETS = ("windows-1251", "cp1251", "utf-8", "utf-8-sig", "koi8-r", "iso-8859-5", "iso-8859-1", "latin-1")
#: Two characters that show text decoded with the wrong charset.
MOJIBAKE = r"Р.|С.|Ð.|Ñ.|Г.|Â.|вЂ.|В«|В»"
#: UTF-8's replacement character, read as cp1251; control characters but tab, line feed and carriage return.
REPLACED, CONTROLS = "пїЅ", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
#: How a document names its charset.
CHARSET_NAMED = (r"<meta[^>]+charset\s*=\s*['\"]?\s*([A-Za-z0-9_\-]+)", r"charset\s*=\s*['\"]?\s*([A-Za-z0-9_\-]+)", r"<\?xml[^>]+encoding\s*=\s*['\"]([^'\"]+)")
#: multibyte: a character of several bytes in strict UTF-8. Other charsets don't give those by chance, so it outweighs any sign.
CHARSET_POINTS = {"domain": 10_000, "function": 120, "cyrillic": 2, "controls": -5000, "replaced": -4000, "tokens": -800, "multibyte": 6000}
CHARSET_BONUS = {"windows-1251": 2500, "cp1251": 2500, "utf-8": 1500, "utf-8-sig": 1500}
DOMAIN_WORDS = (
    "Российской", "Российская", "Россия", "Федерации", "Федерация", "Конституция", "документ", "документы", "постановление", "приказ", "закон",
    "кодекс", "суд", "суда", r"судебн\w*", r"эксперт\w*", r"экспертиз\w*", "Министерство", "Минюст", "юстиции", "правительство", "текст",
    "редакция", r"официальн\w*", r"государственн\w*",
)
FUNCTION_WORDS = ("и", "в", "во", "на", "по", "от", "до", "для", "или", "не", "с", "со", "к", "ко", "о", "об", "из", "за", "при", "как")

# ---- Fixed values: links and sources ----
DOCUMENT_SUFFIXES = (".pdf", ".rtf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".txt")
FOLLOW_WORDS = ("приказ", "постановление", "федеральный закон", "закон", "перечень", "положение", "устав", "регламент", "экспертиз", "эксперт")
SECTION_NAMES = ("own", "presidium-resolutions", "reviews", "statistics", "international_practice", "newsletters", "arbitration")
SECTION_ITEMS = ("own", "practice", "thematics", "reviews", "arbitration")
GENERIC_PATHS = (
    ("pravo.gov.ru", "/"), ("publication.pravo.gov.ru", "/"), ("protect.gost.ru", "/"), ("protect.gost.ru", "/v.aspx"),
    ("minstroyrf.gov.ru", "/"), ("minstroyrf.gov.ru", "/docs"), ("vsrf.ru", "/"), ("vsrf.ru", "/documents"), ("sudexpert.ru", "/"),
)
ALLOWED_GENERIC = (
    "контрольные_источники", "контрольные источники", "правила_актуализации", "правила актуализации", "классификаторы", "официальный раздел",
    "официальный интернет-портал", "официальные_материалы", "официальные материалы",
)
ERROR_LOG_COLUMNS = (
    "registry", "table_no", "row_no", "num", "title", "folder", "original_url", "download_url", "attempted_url", "status", "file_type", "saved_to",
    "text_saved_to", "linked_found", "linked_saved", "linked_errors", "content_type", "encoding", "error",
)

# ---- Fixed values: RTF ----
RTF_SKIPPED = (
    "fonttbl", "colortbl", "stylesheet", "info", "generator", "themedata", "datastore", "listtable", "listoverridetable", "rsidtbl", "xmlnstbl",
    "latentstyles", "filetbl", "revtbl", "pnseclvl", "shppict", "pict", "object", "footer", "header", "footnote", "annotation", "fldinst",
)
RTF_SIGNS = {
    "par": "\n", "line": "\n", "page": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "«", "rquote": "»",
    "ldblquote": "«", "rdblquote": "»",
}

# ---- Fixed values: catalogue search ----
BASE_URL = "http://sniprf.ru"
ALLOWED_HOSTS = ("sniprf.ru", "www.sniprf.ru")
BINARY_SUFFIXES = (".pdf", ".doc", ".docx", ".rtf", ".xls", ".xlsx", ".zip", ".rar")
BAD_URL_PARTS = ("/user", "/login", "/register", "/taxonomy", "/news", "/contact", "/contacts", "/about", "/rss", "/feed", "/print")
BAD_TITLES = ("поиск", "главная", "контакты", "карта сайта", "новости", "вход", "регистрация", "читать далее", "подробнее", "добавить комментарий")
DOCUMENT_MARKERS = (
    "сп ", "сп-", "гост", "свод правил", "строительные нормы", "основания", "здания", "сооружения", "конструкции", "бетонные", "железобетонные",
    "проектирование", "строительство", "фундамент", "фундаменты", "нагрузки", "воздействия", "безопасность", "свайные",
)
YEARS = tuple(range(2025, 2010, -1))
STOP_WORDS = (
    "какие", "какой", "какая", "какое", "документы", "документ", "нужны", "нужен", "нужно", "надо", "требуется", "требуются", "для", "при", "по",
    "на", "и", "в", "во", "с", "со", "к", "ко", "от", "до", "строительства", "строительство",
)
KEPT_WORDS = ("сп", "гост")
SYNONYMS = {
    "фундамент": ("основания", "основание", "фундаменты", "свайные"),
    "фундамента": ("основания", "основание", "фундамент", "свайные"),
    "основания": ("основание", "фундамент", "фундаменты"),
    "бетон": ("бетонные", "железобетонные"),
    "бетонные": ("бетон", "железобетонные"),
    "железобетонные": ("бетонные", "бетон"),
    "дом": ("здание", "здания", "сооружения"),
    "дома": ("здание", "здания", "сооружения"),
}
