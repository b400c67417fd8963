"""Word lists that decide scores. All are fixed values."""

from __future__ import annotations

#: Words without content (profile 1).
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "once", "here", "there", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "can", "will", "just", "don", "should", "now", "is", "am", "are",
    "was", "were", "be", "been", "being", "do", "does", "did", "having", "have", "has", "had", "this", "that",
    "these", "those", "of",
)

#: Words without content that profile 2 adds.
MORE_STOPWORDS = (
    "it", "its", "i", "you", "he", "she", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his",
    "our", "their",
)

#: Terms, and one phrase, that count as toxic.
TOXIC_TERMS = (
    "stupid", "idiot", "dumb", "moron", "hate", "shut up", "trash", "garbage", "loser", "fool", "kill", "die",
    "worthless", "ugly", "lame", "sucks", "nonsense", "nazi", "racist", "sexist",
)

#: Words that name a group of people.
SENSITIVE_TERMS = (
    "male", "female", "man", "woman", "boy", "girl", "trans", "transgender", "nonbinary", "black", "white",
    "asian", "hispanic", "latino", "latina", "indian", "african", "european", "arab", "christian", "muslim",
    "jewish", "hindu", "sikh", "buddhist", "atheist", "american", "chinese", "indian", "russian", "japanese",
    "korean", "german", "british", "french", "disabled", "autistic", "blind", "deaf", "old", "elderly",
    "senior", "young", "youth",
)

#: Words that speak ill of someone.
NEGATIVE_TERMS = (
    "bad", "evil", "lazy", "dirty", "dangerous", "criminal", "violent", "terrible", "awful", "horrible",
    "hate", "disgusting", "stupid", "idiot", "dumb", "inferior", "superior", "less", "worse", "worst", "ugly",
    "worthless", "suspicious", "weak", "untrustworthy", "corrupt",
)

#: Phrases that mark an answer as a refusal.
REFUSAL_PHRASES = (
    "i cannot", "i can't", "i'm unable", "i am unable", "i don't have", "i do not have", "as an ai",
    "as a language model", "i'm not able", "i am not able", "i apologize", "sorry, i cannot",
    "i'm sorry, but i", "i am sorry, but i", "it's not possible", "it is not possible", "i cannot provide",
    "i can't provide", "i cannot help", "i can't help", "i cannot assist", "i can't assist", "out of my scope",
    "beyond my capabilities", "i don't know", "i do not know",
)

#: Substrings of an instruction of the kind technical_code.
TECHNICAL_CODE = (
    "write code", "write a code", "code snippet", "source code", "function", "algorithm", "regex",
    "regular expression", "sql query", "database", "programming", " api ", "api call", "python", "java ",
    "javascript", "html", "css", "c++", "debug", "compile", "syntax error", "variable", "class ", "method",
    "for loop", "while loop", "array", "data structure", "binary tree", "linked list", "hash table", "stack",
    "queue", "recursion", "sorting", "bubble sort", "merge sort", "implement", "script", "terminal",
    "command line", "git", "docker", "server", "http request", "json", "xml", "parse", "encode", "decode",
    "encrypt", "decrypt", "authentication", "backend", "frontend", "framework", "library", "module", "import ",
    "def ", "return ", "print(", "console.log",
)

#: Substrings of an instruction of the kind math_logic.
MATH_LOGIC = (
    "calculate", "compute", "area of", "median", "average", "sum of", "equation", "probability", "percentage",
    "fraction", "decimal", "multiply", "divide", "subtract", "algebra", "geometry", "calculus", "derivative",
    "integral", "sequence", "series", "pattern", "formula", "solve for", "proof", "theorem", "hypothesis",
    "deduce", "infer", "mathematical", "arithmetic", "statistic", "mean of", "standard deviation", "variance",
    "factorial", "permutation", "combination", "prime number", "odd number", "even number", "greater than",
    "less than", "equal to", "how many", "what is the value", "find the", "the answer is",
)

#: Substrings of an instruction of the kind classification_analysis.
CLASSIFICATION_ANALYSIS = (
    "classify", "identify", "tone", "sentiment", "categorize", "odd one out", "label", "theme", "analyze",
    "analysis", "compare", "contrast", "differentiate", "distinguish", "evaluate", "assess", "rate", "rank",
    "prioritize", "pros and cons", "advantages", "disadvantages", "critique", "review", "examine", "inspect",
    "determine", "which of", "sort into", "group", "cluster", "organize", "order",
)

#: Substrings of an instruction of the kind language_editing.
LANGUAGE_EDITING = (
    "rewrite", "summarize", "summary", "translate", "edit", "concise", "active voice", "passive voice",
    "grammar", "paraphrase", "rephrase", "simplify", "shorten", "condense", "proofread", "correct", "fix the",
    "improve", "revise", "formal", "informal", "professional", "casual", "brief", "tl;dr", "key points",
    "main idea", "outline", "synopsis", "convert to", "change to", "make it", "transform",
)

#: Substrings of an instruction of the kind creative_generative.
CREATIVE_GENERATIVE = (
    "write a story", "poem", "haiku", "slogan", "tweet", "post", "recipe", "pitch", "creative", "compose",
    "create a", "generate", "imagine", "fiction", "narrative", "character", "dialogue", "script", "screenplay",
    "lyrics", "song", "jingle", "tagline", "advertisement", "marketing", "brand", "catchy", "engaging",
    "persuasive", "inspiring", "motivational", "emotional", "humorous", "funny", "joke", "riddle", "puzzle",
    "game", "roleplay", "scenario", "hypothetical", "fantasy", "dream", "invent", "design", "brainstorm",
    "idea", "concept",
)

#: Task categories in order of priority.
TASK_RULES = (
    ("technical_code", TECHNICAL_CODE),
    ("math_logic", MATH_LOGIC),
    ("classification_analysis", CLASSIFICATION_ANALYSIS),
    ("language_editing", LANGUAGE_EDITING),
    ("creative_generative", CREATIVE_GENERATIVE),
)
DEFAULT_TASK = "general_qa"
TASKS = tuple(task for task, _ in TASK_RULES) + (DEFAULT_TASK,)
