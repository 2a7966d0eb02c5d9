"""Fixed values of the page format: line layouts, labels and number shapes.

Flags: (?d) makes only a newline end a line, (?m) anchors at lines, (?i) ignores case,
(?s) lets a dot cross lines.
"""

# --- Fixed values: white space and line ends of the input text ----------------
# What goes between brackets. The first part turns visible ASCII away by one comparison; the list alone tries each of its
# ranges on every character, which took most of the time of reading a page.
WS = r"[^!-~]&&[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_NL_WS = r"[^!-~]&&[\t\x0b\f\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space that is not one blank between visible characters, so what becomes a blank anyway is passed over.
WS_RUN = rf"(?=[^!-~])(?:(?! )[{WS}]++| [{WS}]++)"
WS_CHARS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
RARE_WS = r"[[^ -~\t\n]&&[\r\x0b\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"

# --- Fixed values: markup ------------------------------------------------------
WIDE_SPACES = "\u00a0\u2003\u2002\u202f"
ESCAPED = {"\\-": "-", "\\:": ":", "\\&": "&"}
EMPHASIS = ("***", "**", "__")
LINK = r"\[([^\]]+)\]\([^\n]*?\)"
LINE_MARK = rf"(?md)^[#>*]+[{WS}]*"
BULLET = rf"(?md)^[{WS}]*[-*][{WS}]+(?=[A-Za-z\[])"

# --- Fixed values: race header --------------------------------------------------
TRACK_AND_RACE = r"(?mid)^(.+?)\s+Form Guide\s*\(Race\s*(\d+)\)"
TRACK_ONLY = r"(?mid)^(.+?)\s+Form Guide"
RACE_DATE = r"(?mid)^(Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+(.+?\d{4})$"
RACE_TIME = r"(?md)^(\d{1,2}:\d{2})\s*$"
RACE_NAME = r"(?isd)\(local\)\s*\n+\s*([^\n]+?)\s*\n+\s*Type:"
RACE_TYPE = r"(?id)Type:\s*([^\n]+?)(?:\s+Fastest Time:|$)"
FASTEST = r"(?i)Fastest Time:\s*([0-9:.]+)"
PRIZE = r"(?i)AUD\s*\$([\d,]+)"
CONDITIONS = r"(?mid)^(\d{3,4})m\s+([A-Z ]+?)\s+(FAST|GOOD|SLOW|WET|HEAVY)\s*$"

# --- Fixed values: field table ---------------------------------------------------
NAME_HEADERS = ("runner", "greyhound", "dog")
WEIGHT_HEADERS = ("wt", "weight")
TABLE_HEADER = rf"(?mid)^tab(?:[{NOT_NL_WS}]*\t|[{NOT_NL_WS}]{{2}}).*$"
TABLE_ROW = rf"^\d{{1,2}}(?:[{WS}]*\t|[{WS}]{{2}})"
TAB_CELL = r"^\d{1,2}$"
LETTER = r"[A-Za-z]"
WHOLE_SCRATCH = r"(?i)^scr(atched)?$"
WORD_SCRATCH = r"(?i)\bscr\b"
WEIGHT_CELL = r"^\d{2}(?:\.\d+)?$"
PRICE_CELL = r"^\$?\d+(?:\.\d+)?$"
PLAIN_NUMBER = r"^\d+(?:\.\d+)?$"
PIPE_NUMBER = rf"\|[{NOT_NL_WS}]*\d{{1,2}}[{NOT_NL_WS}]*\|"
PIPE_ROW = rf"(?md)^[{NOT_NL_WS}]*\|[{NOT_NL_WS}]*\d{{1,2}}[{NOT_NL_WS}]*\|[^\n]*$"
PIPE_LINK = r"\[\**([^\]]+?)\**\]\("
GLUED_HEADER = r"(?mid)^\|?\s*TabRunnerWTTrainer\b.*$"
SPLIT_HEADER = r"(?mid)^Tab\s*Runner\s*WT\s*Trainer\b.*$"
TABLE_END = r"(?mid)^Explanations\s*$"
RULE_LINE = r"^[|\- ]+$"

# --- Fixed values: runner blocks --------------------------------------------------
BLOCK_MARK = r"(?i)\dyo\b"
BLOCK_HEADER = r"(?i)^(.+?)\s+\d+yo\b"
FORM_AND_PRICE = (
    r"(?mid)^\s*([fFxX0-9]{3,10})\s*$\s*^\s*(betfair|tab)?\s*\$?\s*([0-9]+(?:\.[0-9]+)?)\s*$"
)
PROFILE = r"(?i)^.+?\s+(\d+)yo\s+([A-Z/ ]+?)\s+([A-Z])\s*$"
TRAINER_L50 = (
    r"(?i)Tra\s*L50\s*:?\s*(\d+(?:\.\d+)?)\s*%\s*-\s*(\d+(?:\.\d+)?)\s*%\s*-\s*(\d+)"
)
TRIPLE = r"(\d+(?:\.\d+)?)%\s*-\s*(\d+(?:\.\d+)?)%\s*-\s*(\d+)"
BEST_TIME = r"(?i)Tra/Dist\s*Best\s*Time\s*:?\s*(\d+:\d+(?:\.\d+)?|\d+(?:\.\d+)?)"
ANY_TIME = r"\d+:\d+(?:\.\d+)?|\d+(?:\.\d+)?"
DASHES = r"^[-–—\\]+$"
WHOLE_NUMBER = r"(?<!\d)\d+(?!\d)"
DAYS_SINCE = r"(?i)Days Since Last Run:\s*(\d+)\s*days(?:\s*\((\d+)U\))?"

# --- Fixed values: record and fact strips ------------------------------------------
PERCENT_RECORD = r"(\d+(?:\.\d+)?)%-(\d+(?:\.\d+)?)%-(\d+)"
COUNT_RECORD = r"(\d+)-(\d+)-(\d+)"
RECORD_VALUE = r"\d+(?:\.\d+)?%?\s*-\s*\d+(?:\.\d+)?%?\s*-\s*\d+"
FILTERS = r"(?is)(?=f)\bFilters\b(.*?)(?:\bFacts\b|\z)"
FACTS = r"(?is)(?=f)\bFacts\b(.*?)(?:Best Winning Times|Days Since Last Run|\z)"
FACT_DLS = r"(?i)(?<![A-Za-z])DLS\s*:?\s*(\d+)"
FACT_DLW = r"(?i)(?<![A-Za-z])DLW\s*:?\s*(\d+)"
FACT_ROI = r"(?i)\bROI\s*:?\s*([+-]?\d+(?:\.\d+)?)\s*%"
FACT_CAREER_PM = r"(?i)\bCar PM\s*:?\s*\$([\d.,]+)\s*([kKmM]?)"
FACT_12M_PM = r"(?i)\b12m PM\s*:?\s*\$([\d.,]+)\s*([kKmM]?)"

# --- Fixed values: one past run ------------------------------------------------------
RUN_WORDS = ("Margin", "Distance", "Runner Time")
TRIAL_WORD = "Trial Time"
FINISH_LINE = r"(?i)^(\d+)\s+of\s+(\d+)$"
MARK_LINE = r"(?i)^(\d+)(?:st|nd|rd|th)\s*([+-]?\d+(?:\.\d+)?)$"
RUN_DATE = r"(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})"
RUN_TRACK = r"(?i)([A-Za-z .'-]+)\s*\(AUSTRALIA\):"
RUN_METRICS = {
    "margin": (r"(?i)\bMargin\s*([\d.]+)L", "number"),
    "distance": (r"(?i)\bDistance\s*(\d+)m", "int"),
    "race_time": (r"(?i)\bRace Time\s*([\d:.]+)", "time"),
    "bom": (r"(?i)\bBOM\s*([\d:.]+)sec", "time"),
    "bom_adj": (r"(?i)\bBOM Time Adj\s*([+-]?\d+(?:\.\d+)?)sec", "number"),
    "runner_time": (r"(?i)\bRunner Time\s*([\d:.]+)", "time"),
    "first_split": (r"(?i)\b1st Split\s*([\d.]+)", "number"),
    "prior_box": (r"(?i)\bBP\s*(\d+)", "int"),
    "sp": (r"(?i)\bSP\s*\$([\d.]+)", "number"),
    "weight": (r"(?i)\bR\.WT\s*([\d.]+)kg", "number"),
    "class": (r"(?i)\bClass\s*(.*?)\s*Prize\b", "text"),
}
STEWARDS = (
    r"(?i)\bStewards\s*(.*?)"
    r"(?=\s*Inrunning Position|\s*Runner Sectional|\s*Race/Horse Sectionals|$)"
)
ORDINAL = r"(?:st|nd|rd|th)"
SETTLED = rf"(\d+){ORDINAL} Place on settling(?:\s+(\d+){ORDINAL} Place on turn)?"
SETTLED_LABELLED = rf"(?i)Inrunning Position\s*{SETTLED}"
SETTLED_BARE = rf"(?i){SETTLED}"
SPLIT_RANK = rf"(?i)L1m\s*\([\d.]+\s+(\d+){ORDINAL}\)"
