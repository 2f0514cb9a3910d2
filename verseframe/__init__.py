"""verseframe: DataFrame operators for text collections and the evaluation data around them."""

__version__ = "0.1.0"
