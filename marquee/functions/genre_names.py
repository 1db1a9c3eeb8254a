"""Genre lists for the per-genre top lists."""

from __future__ import annotations

# The genre list as shipped, "Famil y" with its space included.
GENRES_AS_SHIPPED = (
    "Action",
    "Adventure",
    "Animation",
    "Comedy",
    "Crime",
    "Documentary",
    "Drama",
    "Famil y",
    "Fantasy",
    "Foreign",
    "History",
    "Horror",
    "Music",
    "Mystery",
    "Romance",
    "Science",
    "Tv",
    "Thriller",
    "War",
    "Western",
)

# The same list with that one spelling put right; the default.
GENRES = tuple("Family" if genre == "Famil y" else genre for genre in GENRES_AS_SHIPPED)
