"""Fixed values that results depend on.

Windows, thresholds, names, texts and patterns. They are stated once, here, and
imported everywhere else.
"""

# --- price indicators (fixed values) ---
SMA_SHORT = 50
SMA_LONG = 200
RSI_PERIOD = 14
MACD_FAST = 12
MACD_SLOW = 26
MACD_SIGNAL = 9
BAND_WINDOW = 20
BAND_STDS = 2.0
VOLATILITY_WINDOW = 30
TRADING_DAYS = 252
ZERO_WIDTH = 1e-12
INDICATORS = [
    "sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist",
    "bb_middle", "bb_upper", "bb_lower", "bb_pct_b", "hv_30",
]
SUMMARY_INDICATORS = [
    "sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist",
    "bb_upper", "bb_lower", "bb_pct_b",
]

# --- momentum rules (fixed values) ---
RSI_MIDLINE = 50.0
RSI_OVERBOUGHT = 70.0
RSI_OVERSOLD = 30.0
STRONG_SCORE = 5
DIRECTIONAL_SCORE = 3

# --- summary and facts (fixed values) ---
HISTORY_YEARS = 2
HISTORY_TOLERANCE_DAYS = 7
FIFTY_TWO_WEEK_DAYS = 364
TRAILING_YEAR_DAYS = 365
RSI_LOOKBACK = 5
TREND_LOOKBACK = 10
UNAVAILABLE = "unavailable"
PERIOD_MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24}
DEFAULT_PERIOD = "6mo"
VOLATILITY_BOUNDS = (5, 252)
LAST_BARS = 5

# --- hedge levels (fixed values) ---
HORIZON_DAYS = 63
LEVEL_MEANINGS = {
    "one_sd_low": "price minus one expected move: the bottom of the likely 90-day range",
    "one_sd_high": "price plus one expected move: the top of the likely 90-day range",
    "sma_200": "the 200-day moving average, the long-term trend line",
    "bb_lower": "the lower Bollinger Band, two standard deviations below the 20-day average",
    "low_52w": "the lowest price of the past 52 weeks",
}

# --- news and sentiment (fixed values) ---
NEWS_TARGET = 15
NEWS_MIN = 10
NEWS_BOUNDS = (1, 50)
NEWS_TOOL_BOUNDS = (1, 20)
NEWS_MAX_AGE_DAYS = 7
MAX_LABELLED_HEADLINES = 20
PUBLISHER_SEPARATOR = " - "
SENTIMENTS = ["positive", "neutral", "negative"]
SENTIMENT_THRESHOLD = 0.2
TOP_HEADLINES = 3
SEARCH_RESULTS = 5
PROBABILITY_SUM_TOLERANCE = 0.02
NOT_SCORED_REASON = "Not scored: both scorers failed."
REASON_UNAVAILABLE = "No reason available: the LLM call failed."
TOO_FEW_PRICES = " has fewer than {least} daily prices, too few for a {window}-day volatility"
NOT_LABELLED_REASON = "Not scored: no label was returned for this headline."

# --- record limits (fixed values) ---
SENTENCES = (3, 5)
KEY_FACTORS = (2, 4)
RISKS = (3, 3)
EVIDENCE = (1, 3)
LEGS = (1, 3)
SNIPPET_CHARS = 300
TRACE_OUTPUT_CHARS = 200

# --- tools (fixed values) ---
TOOLS = ["get_price_data", "calculate_volatility", "get_news", "llm_sentiment", "web_search"]
ANALYST_TOOLS = ["get_price_data", "calculate_volatility", "llm_sentiment"]
NEED_TOOLS = {
    "price_data": "get_price_data",
    "volatility": "calculate_volatility",
    "sentiment": "llm_sentiment",
}
TOOL_ADVICE = {
    "get_price_data": "Check that {ticker} is a valid Yahoo Finance symbol; calculate_volatility reads the same prices.",
    "calculate_volatility": "A shorter window needs less history.",
    "get_news": "",
    "llm_sentiment": "",
    "web_search": "Try a shorter or differently worded query.",
}
TOOL_ALTERNATIVES = [
    ("get_price_data", 1, "web_search", "search '{ticker} stock price performance' to describe recent moves in words"),
    ("calculate_volatility", 1, "get_price_data", "its indicators include hv_30, the 30-day annualised volatility"),
    ("calculate_volatility", 2, "web_search", "search '{ticker} implied volatility'"),
    ("get_news", 1, "web_search", "search '{ticker} stock news this week' for recent headlines"),
    ("llm_sentiment", 1, "web_search", "search for analyst commentary on {ticker} and judge its tone from the snippets"),
    ("web_search", 1, "get_news", "use recent headlines for {ticker} as commentary instead"),
]
NO_ALTERNATIVE = "No other tool you have can supply this; record it as a data gap and continue with what you have."
INJECTED_FAILURE = "injected failure"
AGENT_LANES = ["direct", "single", "pipeline", "A", "B"]
MESSAGES_ROW = "messages A <-> B"
MESSAGE_SHORT_NAMES = {
    "DataBrief": "brief",
    "ClarificationRequest": "request",
    "ClarificationResponse": "answer",
}

# --- report texts (fixed values) ---
NO_HEADLINES = "No headlines were retrieved, so there is no news sentiment for this brief."
NO_SCORED_HEADLINES = "Headlines were retrieved, but none could be scored."
NO_PRICE_DATA = (
    "no price data came back, so the report was written from a template: "
    "the LLM would have nothing to ground its risks in"
)
PREMIUM_NOTE = (
    "Option premiums are not priced: no tool returns option chains. Levels are indicative strikes "
    "from the expected move and price levels; price the legs from a live chain before acting."
)
PLACEHOLDER_NOTE = (
    "> **Placeholder:** no language model answered, so this Hold is not an analysis. See Data notes."
)
PLACEHOLDER_JUSTIFICATION = (
    "No language model was reachable, so this is a placeholder rather than an analysis. "
    "Hold is shown because it commits to neither direction. "
    "Read the Momentum signal and the indicator values directly instead."
)
PLACEHOLDER_FACTORS = ["Placeholder: the LLM call failed", "Not a judgement on the indicators"]
PUT_RATIONALE = (
    "A put at the bottom of the likely 90-day range limits losses from a move larger than usual. "
    "It is the simplest hedge that covers all three risks at once."
)
TRIM_RATIONALE = (
    "Without price data no option levels can be set, so reducing the position is the only hedge that can be sized."
)
RISK_TEXTS = {
    "Trend reversal": "A break in the price trend could extend losses over the next 90 days.",
    "Volatility": "Larger than usual daily moves widen the range of likely 90-day outcomes.",
    "News sentiment": "Negative news flow can weigh on the share price.",
}
DISCLAIMER = (
    "This brief was generated automatically from public market data and news headlines, "
    "with language models writing the reasoning. It is for information and assessment purposes only "
    "and is not investment advice, a solicitation, or a recommendation to buy or sell any security. "
    "Indicators describe past prices and do not predict future returns; headlines can be incomplete, "
    "late or wrong, and the models can misread them. Do your own research or consult a licensed adviser "
    "before making any investment decision."
)
RECOMMENDATION_DAYS = 90
DEFAULT_REQUEST_QUESTION = (
    "What is the annualised volatility over 63 trading days, the length of the 90-day horizon?"
)
DEFAULT_REQUEST_WHY = (
    "The brief's 30-day volatility is shorter than the report's 90-day horizon; the longer window "
    "shows whether the expected move is understated."
)

# --- corpus (fixed values) ---
TOPICS = [
    "finance", "text", "datetime", "files", "statistics", "data_cleaning",
    "http", "validation", "collections", "geometry", "caching", "simulation",
]
KINDS = ["function", "method", "generator", "async"]
LEVELS = ["simple", "medium", "tricky"]
PER_LEVEL = 2
CODE_LINES = (5, 40)
RECEIVERS = ["self", "cls"]
NAME_STOPWORDS = ["get", "set", "to", "from", "by", "of", "and", "the", "for", "in", "is", "a"]
STDLIB_MODULES = [
    "asyncio", "bisect", "collections", "csv", "datetime", "decimal", "functools", "hashlib", "heapq",
    "itertools", "json", "math", "operator", "os", "pathlib", "random", "re", "shutil", "statistics",
    "string", "time", "urllib", "uuid", "zoneinfo",
]
SHINGLE_CHARS = 5
NEAR_COPY = 0.8
SPLIT_SEED = 42
SPLIT_FRACTION = 0.1
CHECK_LABELS = ["correct", "partial", "hallucinated", "unparseable"]
REVIEW_COUNT = 12
DOC_HEADER = r"^(Args|Arguments|Returns|Yields|Raises):\s*$"
DOC_ENTRY = r"^ {4}(\*{0,2}[A-Za-z_][\w.]*)\s*(?:\([^)]*\))?\s*:"
CODE_FENCE = r"(?m)^```[\w-]*\s*$|^\s*```\s*$"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"
REJECT_DETAIL = r" '.*'|: .*|\d+"
NO_CHART = "_The chart could not be drawn; see Data notes._"
BRIEF_TEMPLATE = """\
# {company} ({ticker}): equity research brief

Generated {generated_at} · market data as of {as_of}

## Company snapshot

| Measure | Value |
|---|---|
| Current price | {price} |
| 52-week high | {high_52w} |
| 52-week low | {low_52w} |
| P/E ratio (trailing) | {pe_ratio} |
| Year-to-date return | {ytd} |
| Momentum signal (rule-based) | {momentum} |

## Technical outlook

{chart}

{technical_facts}

## News sentiment

{sentiment}

## Recommendation: {recommendation} over the next {horizon_days} days

{placeholder}{justification}

**Key factors**

{key_factors}

## How this brief was made

{method}
{data_notes}
---

**Risk disclaimer.** {disclaimer}
"""
RECOMMENDATIONS = ["Buy", "Hold", "Sell"]
STRATEGIES = ["protective_put", "collar", "put_spread", "trim_and_stop"]
TEMPLATE_REASON = "the report model was unavailable, so it was written from a template"
