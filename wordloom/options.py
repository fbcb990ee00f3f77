"""Settings of the cleaning and training jobs, checked while a job is built."""

from dataclasses import dataclass, fields

from wordloom.constants import CHOOSE_OPERATION

# Names of algorithms and vectorizers.
ALGORITHMS = (
    "SVM",
    "Random Forest",
    "Logistic Regression",
    "Naive Bayes",
    "Decision Tree",
    "KNN",
    "Gradient Boosting",
)
VECTORIZERS = ("TF-IDF", "Count", "Hashing")


@dataclass(frozen=True)
class CleanOptions:
    remove_punctuation: bool = False
    remove_special_chars: bool = False
    convert_to_lowercase: bool = False
    convert_to_uppercase: bool = False
    remove_stopwords: bool = False
    stemming: bool = False
    lemmatization: bool = False
    classify_text: bool = False
    # Not an operation: whether ``stemming`` uses the extended form or that of the paper.
    extended_stemmer: bool = True

    def check(self) -> "CleanOptions":
        if not any(getattr(self, f.name) for f in fields(self) if f.name != "extended_stemmer"):
            raise ValueError(CHOOSE_OPERATION)
        return self


# What training and prediction always do to a text.
PRESET = CleanOptions(
    remove_punctuation=True,
    remove_special_chars=True,
    convert_to_lowercase=True,
    remove_stopwords=True,
    lemmatization=True,
)


# The tree classifiers bin every feature of every row, so they always work on so many hash buckets.
TREES = ("Random Forest", "Decision Tree", "Gradient Boosting")
TREE_BUCKETS = 2**12
HASH_BUCKETS = 2**20


@dataclass(frozen=True)
class ModelConfig:
    """One training run.

    ``hash_buckets`` is the width of hashed features: by default 2^20, and 2^12 for the three tree classifiers, which hash
    their terms with every vectorizer. Every algorithm learns from all training rows. ``rounds`` is the number of gradient boosting rounds. ``fit_scope`` says which rows the vectorizer learns from:
    ``all`` or ``train``. ``kernel`` is that of SVM, ``rbf`` or ``linear``; the first is approximated by ``kernel_features`` random
    features, of width ``gamma`` or, without one, by the variance of the training vectors.
    """

    algorithm: str = "SVM"
    vectorizer: str = "TF-IDF"
    c: float = 1.0
    max_depth: int | None = None
    n_estimators: int = 100
    n_neighbors: int = 5
    test_size: float = 0.2
    random_state: int = 42
    rounds: int = 100
    hash_buckets: int | None = None
    fit_scope: str = "all"
    kernel: str = "rbf"
    gamma: float | None = None
    kernel_features: int = 1024

    @property
    def buckets(self) -> int:
        return self.hash_buckets or (TREE_BUCKETS if self.algorithm in TREES else HASH_BUCKETS)

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}, use one of {ALGORITHMS}")
        if self.vectorizer not in VECTORIZERS:
            raise ValueError(f"unknown vectorizer {self.vectorizer!r}, use one of {VECTORIZERS}")
        if not 0 < self.test_size < 1:
            raise ValueError(f"test_size must lie between 0 and 1, not {self.test_size}")
        if self.fit_scope not in ("all", "train"):
            raise ValueError(f"fit_scope must be 'all' or 'train', not {self.fit_scope!r}")
        if self.kernel not in ("rbf", "linear"):
            raise ValueError(f"kernel must be 'rbf' or 'linear', not {self.kernel!r}")
        if self.kernel_features < 2 or self.kernel_features % 2 or (self.gamma is not None and self.gamma <= 0):
            raise ValueError("kernel_features must be even and positive, gamma positive")
        if self.hash_buckets is not None and self.hash_buckets < 1:
            raise ValueError("hash_buckets must be positive")
