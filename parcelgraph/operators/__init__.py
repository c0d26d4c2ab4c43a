"""Operations on packages: lookup, counting, validation, editing, flattening, RDF, nesting."""
