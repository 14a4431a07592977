"""DataFrame operators over Markdown columns and the relations parsed from them."""
