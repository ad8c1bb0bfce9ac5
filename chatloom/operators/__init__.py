"""DataFrame operators: chats, filters, resume, ordered scans, packing, grading, scoring."""
