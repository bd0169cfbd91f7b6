"""Rule packs (data) and the end-to-end flows composed from the operators."""
