"""Stop-word lists.

The English list below is the public NLTK English stop-word list.  The
reference merges it with a project file of extra words; that file is
*input data*, so it is read at run time with ``sources.files.read_stopwords``
and never embedded here.
"""

from __future__ import annotations

# The NLTK English stop-word list, in its published order.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]

# Words the summariser adds to the English list for keyword
# labels.
LABEL_EXTRA_STOP_WORDS = ["study", "research", "paper"]


def default_stop_words() -> list[str]:
    return sorted(set(ENGLISH_STOP_WORDS))


def label_stop_words() -> list[str]:
    return sorted(set(ENGLISH_STOP_WORDS) | set(LABEL_EXTRA_STOP_WORDS))


def sql_list(words) -> str:
    """A DuckDB list literal of the given words."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
