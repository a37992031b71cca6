"""Word lists, messages, patterns and limits that decide results and have to be exactly these."""

from __future__ import annotations

# Conclusions: headings in order of preference, and headings that close one.
CONCLUSION_HEADINGS = [
    r"\n(?:[0-9.]*\s*)?Conclusion\b",
    r"\n(?:[0-9.]*\s*)?Concluding Remarks\b",
    r"\n(?:[0-9.]*\s*)?Summary and Discussion\b",
]
CONCLUSION_STOPS = [
    r"\n(?:[0-9.]*\s*)?References\b",
    r"\n(?:[0-9.]*\s*)?Bibliography\b",
    r"\n(?:[0-9.]*\s*)?Appendix\b",
    r"\n(?:[0-9.]*\s*)?Acknowledg?ments?\b",
    r"\n(?:[0-9.]*\s*)?Supplementary Material\b",
]
# The simple variant: the word anywhere, then headings; its stops end anywhere.
SIMPLE_CONCLUSIONS = ["Conclusion", r"\n(?:[0-9.]*\s*)?Concluding Remarks", r"\n(?:[0-9.]*\s*)?Summary and Discussion"]
SIMPLE_STOPS = [
    r"\n(?:[0-9.]*\s*)?References",
    r"\n(?:[0-9.]*\s*)?Bibliography",
    r"\n(?:[0-9.]*\s*)?Appendix",
    r"\n(?:[0-9.]*\s*)?Acknowledgments",
    r"\n(?:[0-9.]*\s*)?Supplementary Material",
]
CONCLUSION_WORDS, CONCLUSION_PARAGRAPHS, CONCLUSION_CHARS = 500, 6, 1800

# Questions.
PRONOUNS = ["it", "they", "this", "that", "these", "those", "he", "she"]
UNRELATED = ["weather", "restaurant", "movie", "stock", "sports", "recipe", "vacation", "dating", "politics", "bitcoin"]

# Summaries.
BOILERPLATE = [
    "how can ml techniques be applied to improve state-of-the-art results?",
    "the paper presents novel approaches within the ml domain.",
    "key contributions advance the understanding of ml.",
    "this work provides meaningful progress in ml research.",
]
ML_HINTS = ["machine learning", "deep learning", "transformer", "neural", "language model", "llm", "ml"]
QUESTION_WORDS = ["investigate", "study", "examine", "analyze", "measure", "what", "whether"]
METHOD_WORDS = ["method", "approach", "analysis", "experiment", "dataset", "model", "using", "fit", "estimate"]
FINDING_WORDS = ["find", "result", "show", "observe", "improv", "constrain", "evidence", "demonstrate"]

# Answers without a model.
NO_CONTEXT = "I couldn't find enough indexed context for this paper yet. Try again in a minute after chunking completes."
FROM_TEXT = "Based on the paper text I can access: "

# Question categories, the first that fits; none: multi_step.
CATEGORIES = [
    ("money", ["dollar", "money", "$", "price", "cost"]),
    ("time_scheduling", ["hour", "minute", "day", "week", "month", "schedule", "time"]),
    ("arithmetic", ["total", "sum", "together"]),
    ("multiplication", ["each", "every", "per"]),
    ("subtraction", ["left", "remain", "after"]),
    ("division", ["split", "share", "divided"]),
    ("percentage", ["percent", "%", "percentage"]),
    ("geometry_measurement", ["long", "short", "width", "height", "area", "perimeter", "volume", "meter", "inch", "cm"]),
    ("comparison", ["larger", "smaller", "more than", "less than", "compare"]),
]

# Words that reward an answer for its reasoning.
MARKERS = ["Step", "First", "Then", "Finally", "Therefore", "Because"]

# Sections: names that open one, and what they are called.
SECTION_NAMES = [
    "abstract", "introduction", "background", "related work",
    "method", "methods", "methodology", "approach", "experimental setup", "experiments",
    "evaluation", "results", "discussion", "limitations", "conclusion", "concluding remarks",
    "summary and discussion",
]
SECTION_ALIASES = {
    "methods": ["method", "methods", "methodology", "approach", "experimental setup", "experiments"],
    "results": ["result", "results", "evaluation", "discussion"],
    "conclusion": ["conclusion", "concluding remarks", "summary and discussion"],
    "introduction": ["introduction"],
    "background": ["background"],
    "related work": ["related work"],
}
MAX_SECTION_WORDS, MAX_TEXT_WORDS = 25_000, 30_000

# Pages of a document: how many count, the characters of all, and the least that a cut page may keep.
PAGE_LIMIT, TEXT_CHARS, LEAST_REST = 80, 350_000, 200
