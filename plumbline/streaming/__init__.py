"""Empty on purpose: tables are bounded inputs, and none of their operators is defined on an endless one."""
