"""Part of copyfold; see the package README section of the same name."""
