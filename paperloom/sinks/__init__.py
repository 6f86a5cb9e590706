"""Writers for articles, vectors and the search index feed."""
